"""Side-information graphs: edge tables ``(src, dst, weight)`` with ``src <= dst``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.plans import scale


def filter_edges(edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends in the vocabulary, as row indices, and the ends that are not.

    ``edges`` has ``key1, key2``, or ``word1, label1, role1`` and ``word2, label2, role2``, which always name one row each, and
    optionally ``weight`` (default 1). The graph is undirected: repeats and reversed repeats of an edge collapse into one.
    """
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    from lexloom.operators.embedding import check_unambiguous, names_of

    if "key1" in edges.columns:
        on, names = ["key"], scale.materialise(names_of(keys), "names")
        for end in ("key1", "key2"):
            check_unambiguous(edges, names, end)
    else:
        on, names = ["word", "label", "role"], keys
    both = edges
    for end, out in (("1", "_a"), ("2", "_b")):
        found = names.select(*[F.col(c).alias(c + end) for c in on], F.col("ix").alias(out))
        both = scale.lookup_join(both, found, [c + end for c in on])
    kept = (
        both.select(
            F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "weight"
        )
        .groupBy("src", "dst")
        .agg(F.max("weight").alias("weight"))
    )
    ends = [F.struct(*[F.col(c + end).alias(c) for c in on]) for end in ("1", "2")]
    omitted = edges.select(F.inline(F.array(*ends))).distinct().join(names, on=on, how="left_anti")
    return kept, omitted


def chain_graph(vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge between the two forms of each word that occurs in consecutive labels.

    ``labels(label, next_label)`` lists the labels in order.
    """
    steps = labels.where("next_label is not null").select("label", "next_label")
    here = scale.lookup_join(vocab.select("word", "label").distinct(), steps, ["label"])
    there = vocab.select("word", F.col("label").alias("next_label")).distinct()
    return here.join(there, on=["word", "next_label"]).select(
        "word",
        F.col("label").alias("label1"),
        F.col("next_label").alias("label2"),
        F.concat_ws("_", "word", "label").alias("key1"),
        F.concat_ws("_", "word", "next_label").alias("key2"),
        F.lit(1.0).alias("weight"),
    )


def consecutive_labels(labels: DataFrame, order: str) -> DataFrame:
    """``(label, next_label)`` in the order of the column ``order``."""
    placed = scale.dense_index(labels.select("label", order).distinct(), [order, "label"], "_i")
    following = placed.select((F.col("_i") - 1).alias("_i"), F.col("label").alias("next_label"))
    return placed.join(following, on="_i", how="left").select("label", "next_label")


def edge_ends(edges: DataFrame, theta: DataFrame, dim: int) -> DataFrame:
    """Edges with the vectors of both ends.

    A word may have very many edges, so both joins go through the skew-proof lookup.
    """
    first = theta.select(F.col("ix").alias("src"), F.col("vec").alias("src_vec"))
    second = theta.select(F.col("ix").alias("dst"), F.col("vec").alias("dst_vec"))
    return scale.lookup_join(
        scale.lookup_join(edges, first, ["src"], dim=dim), second, ["dst"], dim=dim
    )


def edge_penalties(edges: DataFrame, theta: DataFrame, dim: int) -> DataFrame:
    """Weighted squared distance across each edge."""
    far = vectors.squared_distance(F.col("src_vec"), F.col("dst_vec"))
    return edge_ends(edges, theta, dim).select(
        "src", "dst", "weight", (F.col("weight") * far).alias("penalty")
    )


def laplacian_gradient(edges: DataFrame, theta: DataFrame, dim: int) -> DataFrame:
    """Per row the sum of ``weight * (own vector - neighbour's vector)`` over its edges."""
    pull = vectors.scale(vectors.subtract(F.col("src_vec"), F.col("dst_vec")), F.col("weight"))
    ends = edge_ends(edges, theta, dim).where("src <> dst").withColumn("_pull", pull)
    signed = ends.select(F.explode(F.array(
        F.struct(F.col("src").alias("ix"), F.col("_pull").alias("vec")),
        F.struct(F.col("dst").alias("ix"), vectors.scale(F.col("_pull"), F.lit(-1.0)).alias("vec")),
    )).alias("e")).select("e.ix", "e.vec")
    return vectors.sum_vectors(signed, ["ix"], "vec", dim)
