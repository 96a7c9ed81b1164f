"""Helpers that keep plans sound at scale: lineage cuts, size checks, skew-proof joins, dense indices."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table that is broadcast; above it the joins shuffle.
BROADCAST_BYTES = 256 * 1024 * 1024
# A key holding more than 1/HOT_SHARE of the rows is hot: at most HOT_SHARE keys can be.
HOT_SHARE = 1024


# Spark's session setting by which shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Session setting that lets a task write several folders of a partitioned table at once, and not sort rows by their folder first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
FEW_FOLDERS = 8
# Session setting that names the library's folder; it can be set at run time.
SCRATCH = "lexloom.scratch.dir"
_local_folders: dict[str, str] = {}


def choose_folder(own: str | None, cluster: str | None, master: str, app: str) -> str:
    """The folder set for this library, else the cluster's; a temporary one for a local master only."""
    if own or cluster:
        return own or cluster
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set {SCRATCH} or spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="lexloom-")
    return _local_folders[app]


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``lexloom.scratch.dir``, or ``spark.checkpoint.dir`` as the cluster names it."""
    context = spark.sparkContext
    named = (spark.conf.get(name, None) for name in (SCRATCH, "spark.checkpoint.dir"))
    return choose_folder(*named, context.master, context.applicationId)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of this library through the store's own file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder that Spark has finished writing; none if there is no folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in store.listStatus(place) if store.exists(done(s.getPath(), "_SUCCESS")))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scope(threading.local):
    """The tables stored in the open scopes of this thread, and the values broadcast in them, innermost last."""

    def __init__(self):
        self.open: list[list[str | Broadcast]] = []


_scopes = Scope()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete every table that is stored inside, except those of :class:`Versions`, and every :func:`shared` value.

    For work whose result has been written or computed when the scope ends; a DataFrame that still has to
    read such a table must not leave it.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        for made in _scopes.open.pop():
            made.destroy() if isinstance(made, Broadcast) else delete(spark, made)


def shared(spark: SparkSession, value) -> Broadcast:
    """``value`` for every task. The driver's and the executors' files of it stay until the open scope ends, else the session."""
    made = spark.sparkContext.broadcast(value)
    if _scopes.open:
        _scopes.open[-1].append(made)
    return made


def materialise(
    df: DataFrame,
    name: str = "table",
    partition_by: list[str] | None = None,
    session: SparkSession | None = None,
    few: bool = False,
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (in ``session``, if given).

    Cuts the lineage so that a lost executor costs one read, not a recomputation, and gives
    Catalyst real file sizes, column pruning and pushdown for everything built on top. A partitioned table that
    is said to have ``few`` folders is written without sorting its rows by folder.
    """
    table, path = _stored(df, name, partition_by, session, few)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return table


@contextmanager
def kept_until_the_end(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` stored once and deleted at the end, for what is not read later."""
    table, path = _stored(df, name)
    try:
        yield table
    finally:
        delete(df.sparkSession, path)


def _stored(df, name, partition_by=None, session=None, few=False) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_deleted(spark), _set(spark, WRITERS, str(FEW_FOLDERS if few else 0)):
        writer.parquet(path)
    return (session or spark).read.schema(df.schema).parquet(path), path


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_deleted(spark: SparkSession):
    """What is shuffled for a query that runs inside goes when the query ends: for a table that is written, or a result that is small."""
    return _set(spark, CLEANUP, "true")


class Versions:
    """Versions of a table that replace each other; only the last one and a pinned one are kept on disk.

    A version must not be read any more once the one after it has been stored.
    """

    def __init__(self, name: str, partition_by: list[str] | None = None):
        self.name, self.partition_by = name, partition_by
        self.last = self.pinned = None
        self.few = False  # whether rows are not sorted by their folder first

    def put(self, df: DataFrame) -> DataFrame:
        table, path = _stored(df, self.name, self.partition_by, few=self.few)
        if self.last not in (None, self.pinned):
            delete(df.sparkSession, self.last)
        self.last = path
        return table

    def clear(self, spark: SparkSession) -> None:
        """Delete the last version, unless it is pinned, before the next is stored: for one that is not made from it."""
        if self.last not in (None, self.pinned):
            delete(spark, self.last)
        self.last = None

    def pin(self, spark: SparkSession) -> None:
        """Keep the last version for good, and no longer the one pinned before."""
        if self.pinned not in (None, self.last):
            delete(spark, self.pinned)
        self.pinned = self.last


def spread_small(df: DataFrame, by: list[str]) -> DataFrame:
    """Share a small input out over all cores.

    A table that is one small file would be read, tokenised and exploded by a single task. Inputs of
    more than a few megabytes per core are left as their files split them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *by) if size < cores * 16 * 1024 * 1024 else df


def _width(field: T.DataType) -> int:
    if isinstance(field, (T.StringType, T.BinaryType)):
        return 48
    if isinstance(field, T.ArrayType):
        return 64 * _width(field.elementType)
    return 8


def row_bytes(df: DataFrame, dim: int | None = None) -> int:
    """Rough in-memory width of one row; ``dim`` is the length of its vectors."""
    total = 16
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType) and dim is not None:
            total += 16 + dim * _width(field.dataType.elementType)
        else:
            total += _width(field.dataType)
    return total


def fits_broadcast(df: DataFrame, dim: int | None = None, limit: int | None = None) -> bool:
    """Count the rows of a (materialised) table, and the bytes of its strings, and compare its size with the limit."""
    limit = BROADCAST_BYTES if limit is None else limit
    row = row_bytes(df, dim)
    most = limit // row
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    # What strings have beyond the width that every row is given for them.
    longer = sum((F.greatest(t - 48, F.lit(0)) for t in texts), F.lit(0)).cast("bigint")
    found = df.select(longer.alias("more")).limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("more").alias("more")).first()
    return found["n"] <= most and found["n"] * row + (found["more"] or 0) <= limit


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    dim: int | None = None,
    limit: int | None = None,
    hot: DataFrame | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Equi-join of a large table with a lookup table that has one row per key.

    The lookup side is broadcast only if its counted size is within the limit. Otherwise it is a
    shuffle join in which the hot keys are salted: their rows are spread over all partitions by their place in
    the partition they come from, equal rows as well, and their few lookup rows are copied to each. The place is that in
    the order of a hash of the row, so that a repeated task gives the same salts. ``hot`` may name the hot
    keys when they are known; there are never more than ``HOT_SHARE`` of them, so they are broadcast.
    ``how`` is inner, left, left_semi or left_anti. ``fits`` says that the size has been checked already, and with
    what result.
    """
    if fits_broadcast(small, dim, limit) if fits is None else fits:
        return big.join(F.broadcast(small), on=on, how=how)
    if hot is None:
        hot = hot_keys(big, on)
    hot = materialise(hot.select(*on, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return big.join(small, on=on, how=how)
    hot = F.broadcast(hot)
    # More salts than partitions, as key and salt are hashed together.
    salts = max(64, 2 * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts))
    spread = F.pmod(place, F.lit(salts)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, on=on, how="left").withColumn("_order", F.xxhash64(*big.columns)).sortWithinPartitions("_order").drop("_order")
    left = left.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    right = small.join(hot, on=on, how="left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, on=[*on, "_salt"], how=how).drop("_salt")


def key_counts(df: DataFrame, on: list[str]) -> DataFrame:
    """The keys with the number of their rows, stored."""
    return materialise(df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "key-counts")


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of the rows; never more than HOT_SHARE rows."""
    return hot_of(key_counts(df, on))


def hot_of(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * HOT_SHARE > F.lit(total))


def _range_placed(df: DataFrame, order: list[str], name: str, kept: list[str] | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with partition number and place in it; of their columns those ``kept``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    return materialise(placed if kept is None else placed.select(*kept, "_part", "_row"), name)


def _offsets(placed: DataFrame, amount) -> DataFrame:
    """Sum of ``amount`` over all earlier partitions: one row per shuffle partition."""
    sizes = placed.groupBy("_part").agg(F.sum(amount).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))


def dense_index(df: DataFrame, order: list[str], out: str, kept: list[str] | None = None) -> DataFrame:
    """Number the rows 0..N-1 in the order of ``order`` (which should be unique).

    One range shuffle with a sort inside each partition; the row number is the partition's
    offset plus the place inside it. No window spans the data: the only running sum is over
    the partition sizes. Range bounds split a huge document or label over many tasks. ``kept`` names the columns
    that are wanted besides the number; others are not stored.
    """
    kept = [c for c in (df.columns if kept is None else kept) if c != out]
    placed = _range_placed(df, order, out, kept)
    position = (F.col("_offset") + F.col("_row")).cast("bigint")
    # One offset per shuffle partition, so the broadcast cannot outgrow the partition count.
    return placed.join(F.broadcast(_offsets(placed, F.lit(1))), "_part").select(
        position.alias(out), *kept
    )


def running_total(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows up to and including this one, in the order of ``order``.

    The window only ever spans one range partition; earlier partitions enter as one offset.
    """
    placed = _range_placed(df, order, out)
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.col("_offset") + F.col("_inside")
    return (
        placed.withColumn("_inside", F.sum(amount).over(inside))
        .join(F.broadcast(_offsets(placed, F.col(amount))), "_part")
        .select(*df.columns, total.alias(out))
    )
