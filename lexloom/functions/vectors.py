"""Column expressions on ARRAY<DOUBLE> vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def sum_vectors(df: DataFrame, by: list[str], vec: str, dim: int, *extra: Column) -> DataFrame:
    """Element-wise sum of ``vec`` per group.

    One SUM per element: a hash aggregate with fixed-width buffers, so the partial sums
    are made on the map side and hot keys shrink to one row per task before the shuffle.
    """
    sums = [F.sum(F.col(vec)[d]).alias(f"_s{d}") for d in range(dim)]
    packed = F.array(*[F.col(f"_s{d}") for d in range(dim)]).alias(vec)
    names = [c for c in df.groupBy(*by).agg(*extra).columns if c not in by] if extra else []
    return df.groupBy(*by).agg(*sums, *extra).select(*by, packed, *names)


def log_sigmoid(z: Column) -> Column:
    """Stable log of the logistic function."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
