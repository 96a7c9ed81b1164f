"""Bags scored against an embedding table of any size: one kernel, two ways to bring it the vectors.

A bag has ``targets`` and ``ctx`` (row indices); its logits are the products of every target's vector with
the sum of the context vectors (CBOW), or with each of them (skip-gram). What is wanted of the logits is an emitter: the
gradient's sums, totals, or the logits of each bag. No row per outcome is made and no vector is joined to one.

``broadcast``: vectors up to a counted size go to every task as one array; a large array goes to few tasks, as each
gives back one sum for every vector it touches. ``blocks``, for any vocabulary: the
bags are stored in blocks of bounded size, every block pulls one copy of each vector that it touches, and the emitter runs
on the block with its vectors. A vector meets a block once, however often its word occurs there, so the traffic is
one row per distinct vector and block, and a frequent word is no hot key: no index has more rows than there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.plans import scale

PLANS = ("broadcast", "blocks")
THETA_BYTES = 512 * 1024 * 1024  # most bytes of vectors that every task receives
FEW_BYTES = 8 * 1024 * 1024  # bytes of vectors from which gradients are summed in one task per core
BLOCK_BYTES = 128 * 1024 * 1024  # most bytes of vectors that a block can touch
SLAB_NUMBERS = 65536  # numbers of the neighbouring vectors whose sums are one row
_CHUNK = 16384  # targets and contexts of the bags handled at once inside a task
_EMIT = 10_000  # gradient rows per Arrow batch
_HELD = 2_000_000  # pairs of block and vector that a task holds before it gives them on

GRADIENT = "ix bigint, vec array<double>, log_lik double, n bigint"
SLABS = "slab bigint, places array<int>, vec array<double>, log_lik double, n bigint"
TOTALS = "log_lik double, hits double, n bigint"
_GRADIENT_ARROW = pa.schema([("ix", pa.int64()), ("vec", pa.list_(pa.float64())), ("log_lik", pa.float64()), ("n", pa.int64())])


class Vectors:
    """Rows of the embedding; ``names`` are their indices in order, or None if row k is index k."""

    def __init__(self, rows: np.ndarray, names: np.ndarray | None = None):
        self.rows, self.names = rows, names

    def places(self, ix: np.ndarray) -> np.ndarray:
        if self.names is None:
            return ix
        at = np.minimum(np.searchsorted(self.names, ix), max(len(self.names) - 1, 0))
        if ix.size and (not len(self.names) or (self.names[at] != ix).any()):
            raise ValueError("bags name rows that the embedding does not have")
        return at

    def bags(self, batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
        """Bags of equal shape, a chunk at a time: their rows in the batch, then an array per list column, indices as places."""
        found = [_as_list(batch.column(batch.schema.get_field_index(c))) for c in columns]
        starts = [np.asarray(c.offsets)[:-1] for c in found]
        sizes = [np.diff(np.asarray(c.offsets)) for c in found]
        values = [self.places(v) if c != "x" else v for c, v in ((c, np.asarray(f.values)) for c, f in zip(columns, found))]
        shape = sizes[0].astype(np.int64) << 32 | sizes[-1]
        for code in np.unique(shape):
            rows = np.flatnonzero(shape == code)
            step = max(1, _CHUNK // max(1, int(code >> 32) + int(code & 0xFFFFFFFF)))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                yield part, *(v[start[part][:, None] + np.arange(size[part[0]])] for v, start, size in zip(values, starts, sizes))


def _as_list(column: pa.Array) -> pa.Array:
    """Numbers as lists of one, which share their memory."""
    if pa.types.is_list(column.type):
        return column
    return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32)), column)


def logits(vectors: np.ndarray, targets: np.ndarray, ctx: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target vectors, what they are multiplied with, and the products (bags, targets, contexts or 1)."""
    rho, other = vectors.take(targets, axis=0), vectors.take(ctx, axis=0)
    if kind == "cbow":
        other = np.einsum("bcd->bd", other)[:, None, :]
    return rho, other, _products("btd,bcd->btc", rho, other)


def _products(axes: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products bag by bag: of few numbers by one loop over all bags, else by a product of matrices for each."""
    if a.shape[1] == 1 or b.shape[1] == 1 or 1 in a.shape[2:]:
        return np.einsum(axes, a, b)
    if axes == "btd,bcd->btc":
        return np.matmul(a, b.transpose(0, 2, 1))
    return np.matmul(a.transpose(0, 2, 1), b) if axes == "btc,btd->bcd" else np.matmul(a, b)


class Gradient:
    """Sums of the gradient per vector, and one row with the log likelihood and the number of outcomes."""

    def __init__(self, vectors: Vectors, kind: str):
        self.vectors, self.kind = vectors, kind
        # Pages of rows that are never touched cost no memory.
        self.total, self.touched = np.zeros(vectors.rows.shape), np.zeros(len(vectors.rows), dtype=bool)
        self.log_lik, self.n = 0.0, 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dim = self.total.shape[1]
        for _, targets, outcomes, ctx in self.vectors.bags(batch, "targets", "x", "ctx"):
            rho, other, z = logits(self.vectors.rows, targets, ctx, self.kind)
            error = outcomes[:, :, None] - _sigmoid(z)
            pull = _products("btc,btd->bcd", error, rho).reshape(-1, dim)
            # In CBOW all contexts of a bag get the same pull.
            pulled = np.repeat(np.arange(len(ctx)), ctx.shape[1]) if self.kind == "cbow" else np.arange(len(pull))
            self._add(targets.ravel(), _products("btc,bcd->btd", error, other).reshape(-1, dim), np.arange(targets.size))
            self._add(ctx.ravel(), pull, pulled)
            self.log_lik += float(_log_likelihood(z, outcomes).sum())
            self.n += z.size
        return iter(())

    def _add(self, ix: np.ndarray, rows: np.ndarray, row_of: np.ndarray) -> None:
        """Add ``rows[row_of[k]]`` to vector ``ix[k]`` for every k."""
        if not len(ix):
            return
        # Sorted with its place in one number, which is faster than sorting places.
        bits = len(ix).bit_length()
        both = np.sort(ix.astype(np.int64) << bits | np.arange(len(ix)))
        ordered, order = both >> bits, both & ((1 << bits) - 1)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        self.total[ordered[first]] += np.add.reduceat(rows.take(row_of[order], axis=0), first, axis=0)
        self.touched[ordered[first]] = True

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        found, dim = np.flatnonzero(self.touched), self.total.shape[1]
        for lo in range(0, len(found), _EMIT):
            at = found[lo : lo + _EMIT]
            ends = np.arange(len(at) + 1, dtype=np.int32) * dim
            ix = at if self.vectors.names is None else self.vectors.names[at]
            empty = [pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int64())]
            vec = pa.ListArray.from_arrays(ends, self.total[at].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ix, pa.int64()), vec, *empty], schema=_GRADIENT_ARROW)
        yield pa.RecordBatch.from_pylist([{"ix": None, "vec": None, "log_lik": self.log_lik, "n": self.n}], schema=_GRADIENT_ARROW)


def slab_rows(dim: int) -> int:
    return max(1, SLAB_NUMBERS // dim)


class SlabGradient(Gradient):
    """The same with a row per slab of neighbouring vectors: the places touched in it, and their sums one after another."""

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        found, size = np.flatnonzero(self.touched), slab_rows(self.total.shape[1])
        slabs, places = np.divmod(found if self.vectors.names is None else self.vectors.names[found], size)
        first = np.flatnonzero(np.r_[True, slabs[1:] != slabs[:-1]])
        for lo, hi in zip(first, [*first[1:], len(found)]):
            lists = [pa.array(places[lo:hi], pa.int32()), pa.array(self.total[found[lo:hi]].ravel())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
            yield pa.RecordBatch.from_arrays([pa.array(slabs[lo : lo + 1]), *lists, pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64())], names=_SLAB_NAMES)
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*last, pa.array([self.log_lik]), pa.array([self.n], pa.int64())], names=_SLAB_NAMES)


_SLAB_NAMES = [part.split()[0] for part in SLABS.split(", ")]


def sum_slabs(parts: DataFrame, dim: int) -> DataFrame:
    """``(ix, vec)``: the sums of all tasks. A slab has one row of each task."""
    size = slab_rows(dim)

    def add(rows: pa.Table) -> pa.Table:
        total, touched = np.zeros((size, dim)), np.zeros(size, dtype=bool)
        for batch in rows.to_batches():
            places, vec = batch.column("places"), batch.column("vec")
            starts, sums = np.asarray(places.offsets), np.asarray(vec.offsets)
            for k in range(batch.num_rows):
                at = np.asarray(places.values)[starts[k] : starts[k + 1]]
                total[at] += np.asarray(vec.values)[sums[k] : sums[k + 1]].reshape(-1, dim)
                touched[at] = True
        found = np.flatnonzero(touched)
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * dim)
        return pa.table({"ix": found + rows.column("slab")[0].as_py() * size, "vec": pa.ListArray.from_arrays(ends, total[found].ravel())})

    return parts.where("slab is not null").groupBy("slab").applyInArrow(add, "ix bigint, vec array<double>")


class Totals:
    """One row: the log likelihood, the outcomes given more than one half (ties count half), and the number of outcomes."""

    def __init__(self, vectors: Vectors, kind: str):
        self.vectors, self.kind = vectors, kind
        self.log_lik, self.hits, self.n = 0.0, 0.0, 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, targets, outcomes, ctx in self.vectors.bags(batch, "targets", "x", "ctx"):
            values = _log_likelihood(logits(self.vectors.rows, targets, ctx, self.kind)[2], outcomes)
            self.log_lik += float(values.sum())
            # Rounded, so that a logit of exactly zero is a tie whatever the order of its sum.
            self.hits += float((np.sign(np.round(values - np.log(0.5), 12)) / 2 + 0.5).sum())
            self.n += values.size
        return iter(())

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"log_lik": [self.log_lik], "hits": [self.hits], "n": pa.array([self.n], pa.int64())})


class Logits:
    """Every bag with its logits, target by target."""

    def __init__(self, vectors: Vectors, kind: str):
        self.vectors, self.kind = vectors, kind

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [(rows, logits(self.vectors.rows, t, c, self.kind)[2].reshape(len(rows), -1)) for rows, t, c in self.vectors.bags(batch, "targets", "ctx")]
        width = np.zeros(batch.num_rows, np.int32)
        for rows, z in parts:
            width[rows] = z.shape[1]
        ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        flat = np.empty(ends[-1])
        for rows, z in parts:
            flat[ends[rows][:, None] + np.arange(z.shape[1])] = z
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "z"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _log_likelihood(z: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
    signed = (2.0 * outcomes[:, :, None] - 1.0) * z
    return np.minimum(signed, 0.0) - np.log1p(np.exp(-np.abs(signed)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, small) / (1.0 + small)


def chosen(plan: str | None, theta: DataFrame, dim: int) -> str:
    """The plan given, or the one for vectors of this size."""
    if plan is None:
        plan = "broadcast" if theta.count() * dim * 8 <= THETA_BYTES else "blocks"
    if plan not in PLANS:
        raise ValueError(f"plan is one of {PLANS}, not {plan!r}")
    return plan


def over_bags(
    bags: DataFrame, theta: DataFrame, dim: int, kind: str, emitter: Callable, schema: str, plan: str | None = None
) -> DataFrame:
    """What ``emitter`` makes of the ``bags(targets, [x,] ctx, ..)`` with the vectors of ``theta(ix, vec)``."""
    if chosen(plan, theta, dim) == "broadcast":
        context = bags.sparkSession.sparkContext
        vectors = theta_array(theta, dim)
        if issubclass(emitter, Gradient) and vectors.nbytes > FEW_BYTES:
            bags = bags.coalesce(context.defaultParallelism)
        shared = scale.shared(bags.sparkSession, vectors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = emitter(Vectors(shared.value), kind)
            for batch in batches:
                yield from made.take(batch)
            yield from made.finish()

        return bags.drop("_block").mapInArrow(run, schema)

    if not isinstance(bags.schema["targets"].dataType, T.ArrayType):
        bags = bags.select(*(F.array(c).alias(c) if c in ("targets", "x", "ctx") else c for c in bags.columns))
    placed = in_blocks(bags, dim)
    vectors = _touched(placed).join(theta.select("ix", "vec"), "ix")
    kept = [c for c in bags.columns if c != "_block"]

    def block(rows: pa.Table, pulled: pa.Table) -> pa.Table:
        # A block that two tasks have read pulls a vector from each.
        names, first = np.unique(pulled.column("ix").to_numpy(), return_index=True)
        made = emitter(Vectors(_matrix(pulled.column("vec"), dim)[first], names), kind)
        out = [b for batch in rows.select(kept).combine_chunks().to_batches() for b in made.take(batch)]
        out += made.finish()
        return pa.Table.from_batches(out) if out else arrow_schema.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    return placed.groupBy("_block").cogroup(vectors.groupBy("_block")).applyInArrow(block, schema)


def draws_per_block(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * dim))


def in_blocks(bags: DataFrame, dim: int) -> DataFrame:
    """Stored bags with ``_block``: rows of one task that come one after another, with a bounded number of draws.

    Bags that already have the column are stored in blocks of that size.
    """
    if "_block" in bags.columns:
        return bags
    most = draws_per_block(dim)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, drawn = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("targets", "ctx")]
            running = drawn + np.cumsum(sum(np.diff(np.asarray(c.offsets)).astype(np.int64) for c in lists))
            drawn = int(running[-1]) if len(running) else drawn
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + running // most)], names=[*batch.schema.names, "_block"])

    return scale.materialise(bags.mapInArrow(number, _nullable(bags, ("_block", "bigint"))), "blocks")


def _nullable(df: DataFrame, *more: tuple[str, str]) -> str:
    """The table's columns and some more as a schema that allows nulls everywhere, as Arrow batches do."""
    return ", ".join(f"`{name}` {kind}" for name, kind in [*((f.name, f.dataType.simpleString()) for f in df.schema.fields), *more])


def _touched(placed: DataFrame) -> DataFrame:
    """``_block, ix`` of every vector that a block touches, once per task that reads rows of the block.

    Rows of a block come one after another; pairs that wait for the rest of theirs are bounded."""

    def unique(pairs: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(pairs, axis=1)
        both = both[:, np.lexsort(both[::-1])]
        return both[:, np.r_[True, (both[:, 1:] != both[:, :-1]).any(axis=0)]] if both.shape[1] else both

    def as_batch(both: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["_block", "ix"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, new = np.empty((2, 0), np.int64), 0, []
        for batch in batches:
            blocks, pairs = batch.column("_block").to_numpy(), []
            for c in ("targets", "ctx"):
                lists = batch.column(batch.schema.get_field_index(c))
                pairs.append(np.stack([np.repeat(blocks, np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())]))
            new.append(unique(pairs))
            size += new[-1].shape[1]
            if size < _HELD and held.shape[1] < _HELD:
                continue
            held, size, new = unique([held, *new]), 0, []
            # The last block may go on in the next batch.
            done = held[0] != blocks[-1] if len(blocks) and held.shape[1] < _HELD else np.ones(held.shape[1], bool)
            yield as_batch(held[:, done])
            held = held[:, ~done]
        yield as_batch(unique([held, *new]))

    return placed.select("_block", "targets", "ctx").mapInArrow(distinct, "_block bigint, ix bigint")


def theta_array(theta: DataFrame, dim: int) -> np.ndarray:
    """The vectors as one array; only for tables that passed the size check."""
    table = theta.select("ix", "vec").toArrow()
    out = np.empty((table.num_rows, dim))
    for batch in table.to_batches():
        out[np.asarray(batch.column("ix"))] = np.asarray(batch.column("vec").flatten()).reshape(-1, dim)
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def with_logits(bags: DataFrame, theta: DataFrame, dim: int, kind: str, plan: str | None = None) -> DataFrame:
    """The bags with ``z``: a logit per target (CBOW), or per target and context (skip-gram), target by target."""
    plan = chosen(plan, theta, dim)
    if plan == "broadcast":
        shared = scale.shared(bags.sparkSession, theta_array(theta, dim))

        def z(targets: pa.Array, ctx: pa.Array) -> pa.Array:
            (found,) = Logits(Vectors(shared.value), kind).take(pa.RecordBatch.from_arrays([targets, ctx], names=["targets", "ctx"]))
            return found.column("z")

        # Only what the logits are made of goes to Python and back.
        return bags.drop("_block").withColumn("z", F.arrow_udf(z, "array<double>")("targets", "ctx"))
    schema = _nullable(bags.drop("_block"), ("z", "array<double>"))
    return over_bags(bags, theta, dim, kind, Logits, schema, plan)


def log_likelihoods(rows: DataFrame, ctx: str, theta: DataFrame, dim: int) -> DataFrame:
    """``rows(i, x, <ctx>)`` with ``log_lik``, the log probability of the outcome ``x`` of one centre and one context, or the
    sum of a list of them. For vectors that go to every task; only the three columns go to Python, and a number back."""
    shared = scale.shared(rows.sparkSession, theta_array(theta, dim))

    def score(i: pa.Array, other: pa.Array, x: pa.Array) -> pa.Array:
        vectors = shared.value
        if isinstance(other, pa.ListArray):
            batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32)), i), other], names=["targets", "ctx"])
            z = np.empty(len(i))
            for at, targets, near in Vectors(vectors).bags(batch, "targets", "ctx"):
                z[at] = logits(vectors, targets, near, "cbow")[2].reshape(-1)
        else:
            z = np.einsum("nd,nd->n", vectors.take(i.to_numpy(), axis=0), vectors.take(other.to_numpy(), axis=0))
        found = _log_likelihood(z[:, None, None], x.to_numpy(zero_copy_only=False)[:, None])[:, 0, 0]
        return pa.array(found, mask=np.asarray(x.is_null())) if x.null_count else pa.array(found)

    return rows.withColumn("log_lik", F.arrow_udf(score, "double")("i", ctx, F.col("x").cast("double")))


def totals(bags: DataFrame, theta: DataFrame, dim: int, kind: str, plan: str | None = None) -> DataFrame:
    """One row: ``log_lik``, ``hits`` and ``n`` of all outcomes; each task adds up its own."""
    parts = over_bags(bags.select("targets", "x", "ctx", *[c for c in ["_block"] if c in bags.columns]), theta, dim, kind, Totals, TOTALS, plan)
    return parts.agg(F.sum("log_lik").alias("log_lik"), F.sum("hits").alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
