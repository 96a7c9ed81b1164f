"""Inputs of the catalogue's queries, built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.catalog.sqlparts import CUTOFF, DIM, LIMIT, SEED
from lexloom.functions import hashing, vectors
from lexloom.operators import embedding, text, windows

EMBEDDING_DIM = 64  # length of the vectors in the ``embeddings`` table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The documents after the standard preprocessing, its vocabulary, and the corpus size."""
    tokens = document_tokens(spark, sf_dir)
    prepared = text.preprocess_standard(tokens, ["doc_id", "tok"], None, LIMIT, True, CUTOFF, SEED)
    return prepared.corpus, prepared.vocab, windows.corpus_size(prepared.corpus)


def fresh_model(vocab: DataFrame, dim: int = DIM) -> embedding.EmbeddingModel:
    return embedding.new_embedding(vocab, dim, seed=SEED)


def partitioned(spark: SparkSession, sf_dir: str) -> text.Prepared:
    """The documents as a corpus partitioned by source, in the order of the source's number."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.substring("source", 4, 10).cast("int").alias("part")
    )
    tokens = text.tokenize(docs, ["part", "doc_id"], label="source", lowercase=False)
    return text.preprocess_partitioned(
        tokens, ["doc_id", "tok"], ["part"], limit=LIMIT, cutoff=CUTOFF, seed=SEED
    )


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("label"), F.substring("source", 4, 10).cast("int").alias("part")
    ).distinct()


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, word, label, role, key, vec)`` of the ``embeddings`` table."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("vec_id").cast("string").alias("word"),
        F.col("label").cast("string").alias("label"),
        F.lit("w").alias("role"),
        F.concat_ws("_", "vec_id", "label").alias("key"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def vector_model(rows: DataFrame, vec=None, contexts: bool = False) -> embedding.EmbeddingModel:
    """The vectors as a model; with ``contexts`` they also serve as context vectors."""
    named = rows.select("word", "label", "role", (F.col("vec") if vec is None else vec).alias("vec"))
    if contexts:
        named = named.unionByName(named.withColumn("role", F.lit("c")))
    return embedding.model_from_vectors(named, EMBEDDING_DIM)


def following(rows: DataFrame, steps: int) -> DataFrame:
    """``rows`` with ``next1 .. next<steps>``: keys of the next vectors, or 'none'."""
    names = rows.select("vec_id", "key")
    for s in range(1, steps + 1):
        later = names.select((F.col("vec_id") - s).alias("vec_id"), F.col("key").alias(f"next{s}"))
        rows = rows.join(later, on="vec_id", how="left").withColumn(
            f"next{s}", F.coalesce(f"next{s}", F.lit("none"))
        )
    return rows


def similarity_pairs(rows: DataFrame) -> DataFrame:
    """Each vector with the next one, a gold score with ties, and one data set per label."""
    gold = F.floor(hashing.uniform(SEED, "gold", F.col("vec_id")) * 10).cast("double")
    return following(rows, 1).select(
        F.concat(F.lit("set"), F.col("label")).alias("dataset"),
        F.col("key").alias("word1"),
        F.col("next1").alias("word2"),
        gold.alias("similarity"),
    )


def r6(column) -> Column:
    """Rounded to 6 places. Only near the middle of two results, or far from 0, a decimal number has to be made of it, as
    ``round`` does of every number."""
    column = F.col(column) if isinstance(column, str) else column
    millionths = column * 1e6
    nearest = F.rint(millionths)
    clear = (F.abs(millionths - nearest) < 0.499) & (F.abs(nearest) < 1e12)
    return F.when(clear, nearest / 1e6).otherwise(F.round(column, 6)) + F.lit(0.0)


def long_vectors(df: DataFrame, names: list[str], vec: str = "vec") -> DataFrame:
    """One row per element, rounded for comparison."""
    return df.select(*names, F.posexplode(vec).alias("d", "_value")).select(
        *names, F.col("d").cast("bigint").alias("d"), r6(F.col("_value")).alias("value")
    )


def negated_vectors(vec) -> Column:
    return vectors.scale(vec, F.lit(-1.0))
