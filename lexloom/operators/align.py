"""Relations between fitted models: rotation, transfer, averaging."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.operators.embedding import CONTEXT, EmbeddingModel, located, overwrite
from lexloom.plans import scale


def _rows(reference: EmbeddingModel, model: EmbeddingModel, words: DataFrame) -> DataFrame:
    """``words(key[, key_reference])`` or ``words(word, label, role)`` with the rows they name in both models."""
    if "key" in words.columns and "key_reference" not in words.columns:
        words = words.withColumn("key_reference", F.col("key"))
    found = located(words, model.keys, model.names, "key", "_here")
    return located(found, reference.keys, reference.names, "key_reference", "_there")


def _with_vectors(rows: DataFrame, reference: EmbeddingModel, model: EmbeddingModel, how: str) -> DataFrame:
    here = model.theta.select(F.col("ix").alias("_here"), "vec")
    there = reference.theta.select(F.col("ix").alias("_there"), F.col("vec").alias("vec_reference"))
    return rows.join(here, "_here", how).join(there, "_there", how)


def paired_vectors(reference: EmbeddingModel, model: EmbeddingModel, words: DataFrame) -> DataFrame:
    """The named words with the vectors of both models."""
    return _with_vectors(_rows(reference, model, words), reference, model, "inner").drop("_here", "_there")


# Rows of a model's sums that hold counts, in their first element: words, those missing here, those missing in the reference.
_WORDS, _MISSING, _MISSING_REFERENCE = -1, -2, -3


def cross_product(pairs: DataFrame, dim: int) -> DataFrame:
    """``(d1, row)``: row d1 of the sum over pairs of outer(reference vector, vector)."""
    return cross_products(pairs.withColumn("_model", F.lit(0)), dim).where("d1 >= 0").select("d1", "row")


def cross_products(pairs: DataFrame, dim: int) -> DataFrame:
    """``(_model, d1, row)``: the cross product of every model's pairs (``_model`` is a small number), and its counts.

    Every task sums its own pairs, so a few more than D rows per task and model are shuffled. Pairs without one of the vectors
    are counted only.
    """
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            has = [batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in (1, 2)]
            both = pa.array(has[0] & has[1])
            a, b = (np.asarray(batch.column(c).filter(both).flatten()).reshape(-1, dim) for c in (1, 2))
            paired = of[has[0] & has[1]]
            for m in np.unique(of).tolist():
                total = totals.setdefault(m, np.zeros((dim + 3, dim)))
                total[:dim] += a[paired == m].T @ b[paired == m]
                mine = of == m
                total[dim:, 0] += [(mine & ~has[0]).sum(), (mine & ~has[1]).sum(), mine.sum()]
        places = pa.array([*range(dim), _MISSING_REFERENCE, _MISSING, _WORDS], pa.int64())
        for m, total in totals.items():
            rows = pa.ListArray.from_arrays(np.arange(dim + 4, dtype=np.int32) * dim, total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([m] * (dim + 3), pa.int32()), places, rows], names=["_model", "d1", "row"])

    partial = pairs.select("_model", "vec_reference", "vec").mapInArrow(run, "_model int, d1 bigint, row array<double>")
    return vectors.sum_vectors(partial, ["_model", "d1"], "row", dim)


def rotate(theta: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Multiply every vector by ``matrix`` (D x D, sent to the tasks)."""
    shared = theta.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix))
    dim, out_dim = matrix.shape

    def run(batches):
        for batch in batches:
            turned = np.asarray(batch.column(1).flatten()).reshape(-1, dim) @ shared.value
            ends = np.arange(len(turned) + 1, dtype=np.int32) * out_dim
            vec = pa.ListArray.from_arrays(ends, turned.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], names=["ix", "vec"])

    return theta.select("ix", "vec").mapInArrow(run, "ix bigint, vec array<double>")


def alignment_checks(
    reference: EmbeddingModel, model: EmbeddingModel, words: DataFrame
) -> DataFrame:
    """One row: word pairs, those missing in either model, both dimensions, and whether there are
    enough words to determine a rotation."""
    marked = _rows(reference, model, words)
    count = F.count(F.lit(1))
    return marked.agg(
        count.alias("n_words"),
        F.count_if(F.col("_here").isNull()).alias("n_missing"),
        F.count_if(F.col("_there").isNull()).alias("n_missing_reference"),
        F.lit(model.dim).alias("dim"),
        F.lit(reference.dim).alias("dim_reference"),
        (count >= (model.dim - 1) / 2).alias("determined"),
    )


def rotations(reference: EmbeddingModel, models: Sequence[EmbeddingModel], words: DataFrame) -> list[np.ndarray]:
    """For every model the rotation (reflections allowed) that takes it closest to ``reference`` on the words.

    One job: the words are looked up once per model, and cross products and the checks' counts are summed for all models
    together.
    """
    every = None
    for m, model in enumerate(models):
        if model.dim != reference.dim:
            raise ValueError(f"vectors differ in length: {model.dim} and {reference.dim}")
        rows = _with_vectors(_rows(reference, model, words), reference, model, "left")
        pairs = rows.select(F.lit(m).alias("_model"), "vec_reference", "vec")
        every = pairs if every is None else every.unionByName(pairs)
    dim = reference.dim
    sums = {(r["_model"], r["d1"]): r["row"] for r in cross_products(every, dim).collect()}
    out = []
    for m in range(len(models)):
        n, here, there = (sums.get((m, place), [0.0])[0] for place in (_WORDS, _MISSING, _MISSING_REFERENCE))
        if here or there:
            raise ValueError("not all words are in both models")
        if n < (dim - 1) / 2:
            warnings.warn(f"{int(n)} words do not determine a rotation in {dim} dimensions")
        product = np.array([sums.get((m, d), [0.0] * dim) for d in range(dim)])
        left, _, right_t = np.linalg.svd(product)
        out.append(right_t.T @ left.T)
    return out


def align(
    reference: EmbeddingModel, model: EmbeddingModel, words: DataFrame
) -> EmbeddingModel:
    """Rotate ``model`` (reflections allowed) as close as possible to ``reference`` on the words.

    ``words(key[, key_reference])`` or ``words(word, label, role)`` name the vectors to compare. Only a D x D
    matrix reaches the driver.
    """
    matrix = rotations(reference, [model], words)[0]
    return model.with_theta(scale.materialise(rotate(model.theta, matrix), "aligned"))


def normalize_rotation(model: EmbeddingModel, words: Sequence[str]) -> EmbeddingModel:
    """Rotate all vectors so that the block of the D chosen words is upper triangular."""
    if len(words) != model.dim:
        raise ValueError(f"a rotation in {model.dim} dimensions is normalised by {model.dim} words, not {len(words)}")
    asked = model.theta.sparkSession.createDataFrame([(w,) for w in words], "key string")
    chosen = located(asked, model.keys, model.names, how="inner").join(model.theta, "ix").select("key", "vec").collect()
    block = {r["key"]: r["vec"] for r in chosen}
    missing = [w for w in words if w not in block]
    if missing:
        raise ValueError(f"not in the embedding: {missing[:5]}")
    q, _ = np.linalg.qr(np.array([block[w] for w in words]).T)
    return model.with_theta(scale.materialise(rotate(model.theta, q), "rotated"))


def transfer_embeddings(
    source: EmbeddingModel, target: EmbeddingModel, ignore_group: bool = False
) -> EmbeddingModel:
    """Copy the vectors of the keys both models have into ``target``.

    With ``ignore_group`` words match whatever their label; of several source labels the smallest is taken.
    """
    on = ["word", "role"] if ignore_group else ["word", "label", "role"]
    given = source.keys.select(*on, "label", F.col("ix").alias("_from")) if ignore_group else (
        source.keys.select(*on, F.col("ix").alias("_from"))
    )
    if ignore_group:
        given = given.groupBy(*on).agg(F.min_by("_from", "label").alias("_from"))
    matched = target.keys.select(*on, "ix").join(given, on=on).select("ix", "_from")
    new = matched.join(
        source.theta.select(F.col("ix").alias("_from"), F.col("vec").alias("_new")), on="_from"
    ).select("ix", "_new")
    return target.with_theta(overwrite(target.theta, new))


def posterior_mean(models: Sequence[EmbeddingModel]) -> EmbeddingModel:
    """Align every model with the last one on the context vectors, then average row by row.

    All models must have the same keys.
    """
    reference = models[-1]
    row = ["word", "label", "role"]
    contexts = reference.keys.where(F.col("role") == CONTEXT).select(*row)
    total = None
    # The vectors of every model are read once to find the rotations and once to be rotated and summed.
    for model, matrix in zip(models, rotations(reference, models, contexts), strict=True):
        named = model.keys.select(*row, "ix").join(rotate(model.theta, matrix), on="ix").select(*row, "vec")
        total = named if total is None else total.unionByName(named)
    summed = vectors.sum_vectors(total, row, "vec", reference.dim, F.count(F.lit(1)).alias("_n"))
    summed = scale.materialise(summed, "posterior-sum")
    short = summed.where(F.col("_n") != len(models)).limit(1).count()
    if short:
        raise ValueError("the models do not have the same keys")
    mean = vectors.scale(F.col("vec"), F.lit(1.0 / len(models)))
    theta = summed.join(reference.keys.select(*row, "ix"), on=row).select("ix", mean.alias("vec"))
    return reference.with_theta(theta)
