"""Models on disk: one Parquet table each for keys, vectors and edges, and a one-row ``meta``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.embedding import EmbeddingModel

META = "dim int, lambda0 double, lambda1 double, shared boolean, has_graph boolean"


def _meta(model: EmbeddingModel) -> DataFrame:
    lambda1 = None if model.lambda1 is None else float(model.lambda1)
    row = (model.dim, float(model.lambda0), lambda1, model.shared, model.edges is not None)
    return model.theta.sparkSession.createDataFrame([row], META)


def save_embedding(model: EmbeddingModel, path: str, mode: str = "errorifexists") -> None:
    model.theta.select("ix", "vec").write.mode(mode).parquet(f"{path}/theta")
    model.keys.write.mode(mode).parquet(f"{path}/keys")
    if model.edges is not None:
        model.edges.write.mode(mode).parquet(f"{path}/edges")
    # Written last: a model without meta is incomplete.
    _meta(model).coalesce(1).write.mode(mode).json(f"{path}/meta")


def load_embedding(spark: SparkSession, path: str) -> EmbeddingModel:
    """The model without its graph."""
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    return EmbeddingModel(
        spark.read.parquet(f"{path}/keys"),
        spark.read.parquet(f"{path}/theta"),
        meta["dim"],
        meta["lambda0"],
        meta["shared"],
    )


def load_graph_embedding(spark: SparkSession, path: str) -> EmbeddingModel:
    """The model with its graph and lambda1."""
    plain = load_embedding(spark, path)
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    if not meta["has_graph"]:
        raise ValueError(f"{path} has no graph")
    edges = spark.read.parquet(f"{path}/edges")
    return EmbeddingModel(
        plain.keys, plain.theta, plain.dim, plain.lambda0, plain.shared, edges, meta["lambda1"]
    )


def export_json(model: EmbeddingModel, path: str, mode: str = "errorifexists") -> None:
    """JSON lines: one per key with its vector, one per edge, and the settings."""
    model.vectors().write.mode(mode).json(f"{path}/vectors")
    if model.edges is not None:
        names = model.keys.select("ix", "key")  # the indices identify the ends, the names are for readers
        ends = model.edges.join(
            names.select(F.col("ix").alias("src"), F.col("key").alias("source")), on="src"
        ).join(names.select(F.col("ix").alias("dst"), F.col("key").alias("target")), on="dst")
        ends.select("src", "dst", "source", "target", "weight").write.mode(mode).json(f"{path}/edges")
    _meta(model).coalesce(1).write.mode(mode).json(f"{path}/meta")


VECTORS_SCHEMA = "word string, label string, role string, key string, ix bigint, vec array<double>"


def load_json(spark: SparkSession, path: str) -> EmbeddingModel:
    """A model that ``export_json`` wrote, with its graph if it has one."""
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    rows = spark.read.schema(VECTORS_SCHEMA).json(f"{path}/vectors")
    edges = None
    if meta["has_graph"]:
        edges = spark.read.schema("src bigint, dst bigint, weight double").json(f"{path}/edges")
    return EmbeddingModel(
        rows.drop("vec"), rows.select("ix", "vec"), meta["dim"], meta["lambda0"], meta["shared"], edges, meta["lambda1"]
    )
