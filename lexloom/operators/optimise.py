"""Adam updates and the rotation mask, on tables of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import vectors


@dataclass(frozen=True)
class Adam:
    learning_rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-7

    def moved(self, value: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value and moments after one **ascending** step number ``step`` (from 1)."""
        rate, power = 1 - self.beta1**step, 1 - self.beta2**step
        m = self.beta1 * m + (1 - self.beta1) * grad
        v = self.beta2 * v + (1 - self.beta2) * grad * grad
        return value + self.learning_rate * (m / rate) / (np.sqrt(v / power) + self.epsilon), m, v


def with_new_vectors(rows: DataFrame, names: list[str], made: list[str], change: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """``ix`` and the vectors ``made`` by ``change`` of the vectors ``names``, element by element; a row's vectors are equally long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(1 + k) for k in range(len(names))]
            ends = np.asarray(lists[0].offsets)
            ends = pa.array(ends - ends[0], pa.int32())
            found = change(*(np.asarray(one.flatten()) for one in lists))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in found)], names=["ix", *made])

    return rows.select("ix", *names).mapInArrow(run, ", ".join(["ix bigint", *(f"{c} array<double>" for c in made)]))


def with_moments(theta: DataFrame, dim: int) -> DataFrame:
    return theta.select("ix", "vec", vectors.zeros(dim).alias("m"), vectors.zeros(dim).alias("v"))


def adam_step(state: DataFrame, gradient: DataFrame, step: int, adam: Adam = Adam()) -> DataFrame:
    """Next ``(ix, vec, m, v)`` from this one and ``gradient(ix, grad)``; the prior touches every row."""
    joined = state.join(gradient, on="ix")
    return with_new_vectors(joined, ["vec", "m", "v", "grad"], ["vec", "m", "v"], lambda *old: adam.moved(*old, step))


# Fixed value: log standard deviation given to the masked dimensions.
MASKED_LOG_STD = -10.0


def rotation_mask(state: DataFrame, fixed: DataFrame) -> DataFrame:
    """Keep ``keep_dims`` leading dimensions of the rows named in ``fixed(ix, keep_dims)``.

    In the others the mean becomes 0 and the log standard deviation -10. ``fixed`` has fewer rows
    than the vectors have dimensions.
    """
    def masked(name: str, filler: float) -> Column:
        cut = F.transform(
            F.col(name), lambda x, d: F.when(d < F.col("keep_dims"), x).otherwise(F.lit(filler))
        )
        return F.when(F.col("keep_dims").isNull(), F.col(name)).otherwise(cut)

    return (
        state.join(F.broadcast(fixed), on="ix", how="left")
        .withColumns({"mean": masked("mean", 0.0), "log_std": masked("log_std", MASKED_LOG_STD)})
        .drop("keep_dims")
    )
