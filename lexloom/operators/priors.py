"""Priors of an embedding: what a model believes about its vectors before it sees data.

The extension point of the library: a prior of one's own is an object with these two methods, given to
``new_embedding(..., prior=..)``. Estimation asks it for nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.operators import graph


@runtime_checkable
class Prior(Protocol):
    def log_prob(self, theta: DataFrame, dim: int) -> DataFrame:
        """One row ``(log_prob)`` for all the vectors of ``theta(ix, vec)``, up to a constant."""

    def gradient(self, theta: DataFrame, dim: int) -> DataFrame:
        """``(ix, vec)``: the gradient of ``log_prob``, one row for every row of ``theta``."""


@dataclass(frozen=True)
class GaussianPrior:
    """``-lambda0 / 2`` times the sum of the squared elements."""

    lambda0: float = 1.0

    def log_prob(self, theta: DataFrame, dim: int) -> DataFrame:
        total = F.coalesce(F.sum(vectors.squared_norm(F.col("vec"))), F.lit(0.0))
        return theta.agg((F.lit(-0.5 * self.lambda0) * total).alias("log_prob"))

    def gradient(self, theta: DataFrame, dim: int) -> DataFrame:
        return theta.select("ix", vectors.scale(F.col("vec"), F.lit(-self.lambda0)).alias("vec"))


@dataclass(frozen=True)
class LaplacianPrior:
    """The Gaussian prior, and ``-lambda1 / 2`` times the weighted squared distances over ``edges(src, dst, weight)``."""

    lambda0: float
    lambda1: float
    edges: DataFrame

    def log_prob(self, theta: DataFrame, dim: int) -> DataFrame:
        far = graph.edge_penalties(self.edges, theta, dim).agg(
            (F.lit(-0.5 * self.lambda1) * F.coalesce(F.sum("penalty"), F.lit(0.0))).alias("_far")
        )
        both = GaussianPrior(self.lambda0).log_prob(theta, dim).crossJoin(far)  # one row each
        return both.select((F.col("log_prob") + F.col("_far")).alias("log_prob"))

    def gradient(self, theta: DataFrame, dim: int) -> DataFrame:
        pull = graph.laplacian_gradient(self.edges, theta, dim).select(
            "ix", vectors.scale(F.col("vec"), F.lit(-self.lambda1)).alias("_pull")
        )
        own = GaussianPrior(self.lambda0).gradient(theta, dim).join(pull, on="ix", how="left")
        return own.select("ix", F.coalesce(vectors.add(F.col("vec"), F.col("_pull")), "vec").alias("vec"))
