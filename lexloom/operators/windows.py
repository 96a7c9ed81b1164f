"""Training examples: circular context windows, negative samples, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import hashing
from lexloom.plans import scale

MODELS = ("cbow", "sgns")
BLOCK = 4096
TASK_BLOCKS = 16  # blocks that are worth a task
POOL_BYTES = 256 * 1024 * 1024  # largest table of values that every task receives to draw negatives
RANGE_DRAWS = 1_000_000  # draws of a range, beyond that table
WRITTEN_OUT = 16  # draws per position up to which each is an expression of its own, which Spark compiles
TASK_PAIRS = 2_000_000  # pairs of a task that holds whole centres


def check_model(model: str) -> None:
    if model not in MODELS:
        raise ValueError(f"unknown kind of model {model!r}; there are {' and '.join(MODELS)}")


def corpus_size(corpus: DataFrame) -> int:
    return int(corpus.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0])


def context_windows(
    corpus: DataFrame,
    ws: int,
    size: int,
    value: str = "word",
    keep: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """For each position the ``ws`` values to the left (nearest first), then to the right.

    The corpus is circular. Positions are cut in blocks and each block also gets the ``ws``
    rows beyond both its ends, so one shuffle of about N rows suffices and no block is larger
    than any other, whatever the words or documents are.
    """
    keep = ["word", "label"] if keep is None else keep
    rows = corpus.select("pos", *dict.fromkeys([*keep, value]))
    if size == 0:
        return rows.select("pos", *keep, F.array(F.col(value)).alias("ctx"))
    if size <= 2 * ws:
        return _tiny_windows(rows, ws, size, value, keep)
    block = max(block, ws + 1)
    placed = _placed(rows, ws, size, block)
    return placed.mapInArrow(_windowed(ws, size, value, keep, block), _kinds(rows, ["pos", *keep], ctx=value))


def _kinds(rows: DataFrame, columns: list[str], **lists: str) -> str:
    """The columns' schema, and lists of the values of others."""
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in dict.fromkeys(columns)]
    kinds += [(name, f"array<{rows.schema[c].dataType.simpleString()}>") for name, c in lists.items()]
    return ", ".join(f"`{name}` {kind}" for name, kind in kinds)


def _placed(rows: DataFrame, ws: int, size: int, block: int) -> DataFrame:
    """Rows and the rows seen from the next block, in the order of ``_place``, which numbers the ``block + 2 * ws`` places of
    each block. A partition has whole blocks. ``pos`` runs on beyond the ends of the circle where it is seen from there."""
    span, pos = block + 2 * ws, F.col("pos")
    others = [c for c in rows.columns if c != "pos"]
    # Rows near a block edge, or near the seam of the circle, are also seen from next door.
    near_edge = (pos % block < ws) | (pos % block >= block - ws) | (pos >= size - ws)
    around = F.explode(F.array(pos, pos + F.lit(size), pos - F.lit(size)))
    reach = F.sequence(
        F.floor((F.col("_at") - ws) / block).cast("bigint"),
        F.floor((F.col("_at") + ws) / block).cast("bigint"),
    )
    last = (size - 1) // block
    halo = (
        rows.where(near_edge)
        .withColumn("_at", around)
        .where((F.col("_at") >= -ws) & (F.col("_at") < size + ws))
        .withColumn("_block", F.explode(reach))
        .where(F.col("_block").between(0, last))
        .where((F.col("_at") != pos) | (F.col("_block") != F.floor(pos / block)))
        .select((F.col("_block") * (2 * ws) + F.col("_at") + ws).alias("_place"), *others)
    )
    own = rows.select((F.expr(f"pos div {block}") * (2 * ws) + pos + ws).alias("_place"), *others)
    # As many partitions as there is work for: left to their bytes, which are few, they would be too few for the cores.
    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + last // TASK_BLOCKS)
    both = own.unionByName(halo).repartition(parts, F.expr(f"_place div {span}")).sortWithinPartitions("_place")
    at = (F.col("_place") - F.expr(f"_place div {span}") * (2 * ws) - ws).cast(rows.schema["pos"].dataType)
    return both.select("_place", at.alias("pos"), *others)


def _windowed(ws: int, size: int, value: str, keep: list[str], block: int):
    """Of the rows of :func:`_placed` those of the block itself, with the values around each."""
    span, steps = block + 2 * ws, np.array([*range(-1, -ws - 1, -1), *range(1, ws + 1)], dtype=np.int64)
    kept = list(dict.fromkeys(["pos", *keep]))

    def made(rows: pa.RecordBatch, lo: int, hi: int) -> pa.RecordBatch:
        blocks, inside = np.divmod(rows.column("_place").to_numpy(), span)
        inside, pos = inside[lo:hi] - ws, rows.column("pos").to_numpy()[lo:hi]
        own = lo + np.flatnonzero((inside >= 0) & (inside < block) & (pos < size))
        near = own[:, None] + steps
        known = np.clip(near, 0, len(blocks) - 1)
        # Beyond the block there is nothing, as where a position is missing.
        outside = (near != known) | (blocks[known] != blocks[own][:, None])
        around = rows.column(value).take(pa.array(known.ravel(), mask=outside.ravel() if outside.any() else None))
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(steps))
        found = [rows.column(c).take(pa.array(own)) for c in kept]
        return pa.RecordBatch.from_arrays([*found, pa.ListArray.from_arrays(ends, around)], names=[*kept, "ctx"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # the rows that the next ones need, and how many of them have been given
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            # The last rows wait for those that follow.
            end = max(done, rows.num_rows - ws)
            if end > done:
                yield made(rows, done, end)
            first = max(0, end - ws)
            held, done = rows.slice(first), end - first
        if held is not None and held.num_rows > done:
            yield made(held, done, held.num_rows)

    return windows


def _tiny_windows(rows, ws, size, value, keep):
    """Corpora of at most ``2 * ws`` tokens, where a window wraps around itself."""
    steps = list(range(-1, -ws - 1, -1)) + list(range(1, ws + 1))
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in enumerate(steps)])
    others = rows.select(F.col("pos").alias("_at"), F.col(value).alias("_value"))
    reached = rows.select("pos", F.explode(offsets).alias("s")).select(
        "pos", "s.k", F.pmod(F.col("pos") + F.col("s.o"), F.lit(size)).alias("_at")
    )
    ctx = reached.join(F.broadcast(others), "_at").groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct("k", "_value"))).getField("_value").alias("ctx")
    )
    return rows.join(F.broadcast(ctx), "pos").select("pos", *keep, "ctx")


def with_negatives(
    rows: DataFrame, pool: DataFrame, pool_size: int, ns: int, seed: int, value: str, limit: int | None = None
) -> DataFrame:
    """Add ``_drawn``, ``ns`` places among the pool's tokens per ``pos``, and ``_negatives``, the values there.

    Tokens are drawn uniformly, so values by their counts. A place is looked up in the running counts of the values
    in their order, by binary search inside the task that holds the row: nothing is shuffled. Values
    beyond ``limit`` bytes are looked up by a merge of ranges of places instead.
    """
    counts = _unigrams(pool, value)
    rows = rows.withColumn("_drawn", _draws(pool_size, ns, seed))
    return _looked_up(rows, counts, _searchable(counts, limit))


def _unigrams(pool: DataFrame, value: str) -> DataFrame:
    counts = pool.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return scale.materialise(counts, "unigrams")


def _draws(pool_size: int, ns: int, seed: int):
    def draw(k):
        return hashing.draw_index(pool_size, seed, "negative", F.col("pos"), k)

    if 0 < ns <= WRITTEN_OUT:
        return F.array(*[draw(F.lit(k)) for k in range(1, ns + 1)])
    return F.transform(F.sequence(F.lit(1), F.lit(ns)), draw)


def _searchable(counts: DataFrame, limit: int | None = None) -> bool:
    """Whether the arrays that are searched, a running count and a value per row, are within the limit."""
    limit = min(POOL_BYTES, scale.BROADCAST_BYTES) if limit is None else limit
    text = isinstance(counts.schema["value"].dataType, T.StringType)
    more = F.sum(F.octet_length("value")) if text else F.lit(0)
    found = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(more, F.lit(0)).cast("bigint").alias("more")).first()
    return 16 * found["n"] + found["more"] <= limit


def _looked_up(rows: DataFrame, counts: DataFrame, searchable: bool) -> DataFrame:
    if not searchable:
        return _merged(rows, counts)
    return rows.mapInArrow(_search(counts), _with_negatives(_kinds(rows, rows.columns), counts))


def _with_negatives(kinds: str, counts: DataFrame) -> str:
    return f"{kinds}, _negatives array<{counts.schema['value'].dataType.simpleString()}>"


def _search(counts: DataFrame):
    """Batches with ``_drawn`` and the values there."""
    shared = _running(counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, values = shared.value
        for batch in batches:
            drawn = batch.column(batch.schema.get_field_index("_drawn"))
            ends = np.asarray(drawn.offsets)
            at = np.searchsorted(lows, np.asarray(drawn.flatten()), side="right") - 1
            picked = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), values.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, picked], names=[*batch.schema.names, "_negatives"])

    return search


def _running(counts: DataFrame):
    """For every task: the values in their order, and before them how many tokens have smaller ones."""
    found = counts.toArrow().sort_by("value").combine_chunks()
    n = found.column("n").to_numpy()
    return scale.shared(counts.sparkSession, (np.cumsum(n) - n, found.column("value").combine_chunks()))


def _merged(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Draws and values meet by range of places. Draws are spread evenly, so no range is hot; a value is copied to every
    range it reaches into, which adds at most one row per range."""
    rows = scale.materialise(rows, "drawn")
    table = scale.running_total(counts, ["value"], "n", "_high")
    table = scale.materialise(table.select("value", "n", (F.col("_high") - F.col("n")).alias("_low")), "running-unigrams")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ns = rows.agg(F.coalesce(F.sum(F.size("_drawn")), F.lit(0))).first()[0]
    width = max(1, -(-total // max(parts, ns // RANGE_DRAWS)))
    draws = rows.select("pos", F.posexplode("_drawn").alias("k", "drawn")).withColumn("range", F.expr(f"drawn div {width}"))
    reach = F.sequence(F.expr(f"_low div {width}"), F.expr(f"(_low + n - 1) div {width}"))
    values = table.select("value", "_low", F.explode(reach).alias("range"))

    def merge(draws: pa.Table, values: pa.Table) -> pa.Table:
        values = values.sort_by("_low")
        at = np.searchsorted(values.column("_low").to_numpy(), draws.column("drawn").to_numpy(), side="right") - 1
        picked = values.column("value").take(pa.array(at))
        return pa.table({"pos": draws.column("pos"), "k": draws.column("k"), "value": picked})

    kind = table.schema["value"].dataType.simpleString()
    met = draws.groupBy("range").cogroup(values.groupBy("range")).applyInArrow(merge, f"pos bigint, k int, value {kind}")
    lists = met.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).getField("value").alias("_negatives"))
    return rows.join(lists, "pos", "left").withColumn("_negatives", F.coalesce("_negatives", F.array().cast(f"array<{kind}>")))


def negative_samples(
    positions: DataFrame, pool: DataFrame, pool_size: int, ns: int, seed: int = 0, value: str = "word", limit: int | None = None
) -> DataFrame:
    """``(pos, k, drawn, <value>)``: ``ns`` tokens per position, drawn uniformly from the pool.

    ``pool`` is the corpus itself or another corpus; ``drawn`` is the place among its tokens in the order of their values.
    """
    found = with_negatives(positions.select("pos"), pool, pool_size, ns, seed, value, limit)
    both = F.arrays_zip(F.col("_drawn").alias("drawn"), F.col("_negatives").alias(value))
    return found.select("pos", F.posexplode(both).alias("k", "d")).select("pos", (F.col("k") + 1).alias("k"), "d.*")


def cbow_examples(
    corpus: DataFrame,
    size: int,
    ws: int = 5,
    ns: int = 5,
    batch_size: int = 25000,
    seed: int = 0,
    value: str = "word",
    pool: DataFrame | None = None,
    pool_size: int | None = None,
    keep_tail: bool = True,
) -> DataFrame:
    """Rows ``(ex_id, batch_id, i, ctx, x)``: each window once with its own centre (x = 1) and
    ``ns`` times with a drawn centre (x = 0)."""
    bags = example_bags(
        corpus, size, ws, ns, batch_size, seed, value, value, pool, pool_size, keep_tail
    )
    per_centre = F.posexplode(F.arrays_zip("targets", "x"))
    return bags.select("bag_id", "batch_id", "ctx", per_centre).select(
        (F.col("bag_id") * (1 + ns) + F.col("pos")).alias("ex_id"),
        "batch_id",
        F.col("col.targets").alias("i"),
        "ctx",
        F.col("col.x").alias("x"),
    )


def sgns_pairs(examples: DataFrame) -> DataFrame:
    """One row per centre and context word."""
    return examples.select("ex_id", "batch_id", "i", F.explode("ctx").alias("j"), "x")


def generate_examples(corpus: DataFrame, size: int, model: str = "cbow", by_centre: bool = False, **options) -> DataFrame:
    """``by_centre`` brings the examples of a centre and outcome together before they become pairs, so that grouping
    by them (and more) shuffles each window once per centre and not once per pair."""
    check_model(model)
    examples = cbow_examples(corpus, size, **options)
    if by_centre:
        pairs = size * (1 + options.get("ns", 5)) * 2 * options.get("ws", 5)
        parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        examples = examples.repartition(max(parts, -(-pairs // TASK_PAIRS)), "i", "x")
    return sgns_pairs(examples) if model == "sgns" else examples


def example_bags(
    corpus: DataFrame,
    size: int,
    ws: int = 5,
    ns: int = 5,
    batch_size: int = 25000,
    seed: int = 0,
    centre: str = "wix",
    context: str = "cix",
    pool: DataFrame | None = None,
    pool_size: int | None = None,
    keep_tail: bool = True,
) -> DataFrame:
    """One row per window: ``targets`` = its centre and the drawn ones, ``x`` = 1, 0, ..., 0.

    The window is stored once for its 1 + ns examples; its negatives are found where it is. The last batch holds what is left, unless ``keep_tail`` is off. Negatives come from
    ``pool(pos, ..)``, whose size is counted unless given, or from the corpus itself.
    """
    targets = F.array(F.col(centre))
    if ns > 0:
        if pool is None:
            pool, pool_size = corpus, size
        elif pool_size is None:
            pool_size = corpus_size(pool)
        if pool_size < 1 and size > 0:
            raise ValueError("negatives cannot be drawn from an empty pool")
        windows = _windows_with_negatives(corpus, size, ws, ns, seed, centre, context, pool, pool_size)
        targets = F.col("_targets")
    else:
        windows = context_windows(corpus, ws, size, value=context, keep=[centre])
    windows = windows.where(_whole_batches(size, batch_size, keep_tail))
    return windows.select(
        F.col("pos").alias("bag_id"),
        _batch(batch_size).alias("batch_id"),
        targets.alias("targets"),
        F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), ns)).alias("x"),
        "ctx",
    )


def _windows_with_negatives(corpus, size, ws, ns, seed, centre, context, pool, pool_size) -> DataFrame:
    """Windows with ``_targets``, the centre and its negatives; a table that can be searched is, by the task that makes the windows,
    and the draws are made there too."""
    counts = _unigrams(pool, centre)
    block, searchable = max(BLOCK, ws + 1), _searchable(counts)
    if size <= 2 * ws or not searchable:
        rows = context_windows(corpus, ws, size, value=context, keep=[centre]).withColumn("_drawn", _draws(pool_size, ns, seed))
        return _looked_up(rows, counts, searchable).withColumn("_targets", F.concat(F.array(F.col(centre)), F.col("_negatives")))
    placed = _placed(corpus.select("pos", *dict.fromkeys([centre, context])), ws, size, block)
    windowed, shared = _windowed(ws, size, context, [centre], block), _running(counts)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, values = shared.value
        for batch in windowed(batches):
            pos, own, n = batch.column("pos").to_numpy(), batch.column(centre), batch.num_rows
            drawn = np.empty((n, ns), np.int64)
            for k in range(ns):
                drawn[:, k] = hashing.draw_index_array(pool_size, seed, "negative", pos, k + 1)
            picked = values.take(pa.array(np.searchsorted(lows, drawn.ravel(), side="right") - 1)).cast(own.type)
            # A row's centre, then its negatives.
            order = np.concatenate([np.arange(n)[:, None], n + np.arange(n * ns).reshape(n, ns)], axis=1)
            targets = pa.concat_arrays([own, picked]).take(pa.array(order.ravel()))
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * (1 + ns))
            yield pa.RecordBatch.from_arrays(
                [batch.column("pos"), batch.column("ctx"), pa.ListArray.from_arrays(ends, targets)], names=["pos", "ctx", "_targets"]
            )

    return placed.mapInArrow(both, _kinds(placed, ["pos"], ctx=context, _targets=centre))


def _batch(batch_size: int):
    return F.floor(F.col("pos") / F.lit(batch_size)).cast("bigint")


def _whole_batches(size: int, batch_size: int, keep_tail: bool):
    last = size if keep_tail else size // batch_size * batch_size
    return F.col("pos") < F.lit(last)


def assign_batches(
    corpus: DataFrame, size: int, batch_size: int, epoch: int = 0, seed: int = 0, keep_tail: bool = True
) -> DataFrame:
    """Positions with their batch and the batch's turn in this epoch's random order."""
    batched = corpus.where(_whole_batches(size, batch_size, keep_tail)).select(
        "pos", _batch(batch_size).alias("batch_id")
    )
    count = -(-size // batch_size) if keep_tail else size // batch_size
    turns = batch_order(corpus, count, epoch, seed)
    return scale.lookup_join(batched, turns, ["batch_id"])


def batch_order(df: DataFrame, batches: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """``(batch_id, turn)``: the batches in hash order."""
    ids = df.sparkSession.range(batches).select(F.col("id").alias("batch_id"))
    drawn = ids.withColumn("_u", hashing.uniform(seed, "batch", F.lit(epoch), F.col("batch_id")))
    return scale.dense_index(drawn, ["_u", "batch_id"], "turn").select("batch_id", "turn")


def external_examples(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Supplied ``(i, j, x)`` or ``(i, ctx, x)`` rows of names as rows of indices.

    ``i``, ``j`` and the elements of ``ctx`` name rows of either role. A name outside the vocabulary, or one
    that names two rows, is an error.
    """
    from lexloom.operators.embedding import check_unambiguous, names_of

    names = scale.materialise(names_of(keys), "names")
    others = [c for c in pairs.columns if c not in ("i", "j", "ctx")]

    def checked(rows: DataFrame, *columns: str) -> list[DataFrame]:
        """The hot names of each column, from a count of all names in one pass over the rows, in which unknown names are found too."""
        for column in columns:
            check_unambiguous(rows, names, column)
        asked = F.posexplode(F.array(*(F.struct(F.col(c).alias("key")) for c in columns))).alias("_column", "_name")
        counts = scale.key_counts(rows.select(asked).select("_column", "_name.key"), ["_column", "key"])
        with scale.shuffles_deleted(rows.sparkSession):
            missing = scale.lookup_join(counts.select("key"), names.select("key"), ["key"], how="left_anti")
            sample = [r["key"] for r in missing.limit(5).collect()]
        if sample:
            raise ValueError(f"examples name words outside the vocabulary, such as {sample}")
        one = [counts.where(F.col("_column") == k).select(F.col("key").alias(c), "n") for k, c in enumerate(columns)]
        return [scale.hot_of(c).drop("n") for c in one]

    def numbered(rows: DataFrame, column: str, hot: DataFrame) -> DataFrame:
        found = names.select(F.col("key").alias(column), F.col("ix").alias("_ix"))
        return scale.lookup_join(rows, found, [column], how="left", hot=hot).drop(column).withColumnRenamed("_ix", column)

    if "ctx" not in pairs.columns:
        i, j = checked(pairs, "i", "j")
        return numbered(numbered(pairs, "i", i), "j", j).select("i", "j", *others)
    # The contexts of a row are looked up one by one and put together again in their order.
    rows = scale.materialise(pairs.withColumn("_row", F.monotonically_increasing_id()), "examples")
    flat = rows.select("_row", F.posexplode("ctx").alias("_k", "j"))
    flat = numbered(flat, "j", *checked(flat, "j"))
    ctx = flat.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_k", "j"))).getField("j").alias("ctx"))
    placed = numbered(rows.drop("ctx"), "i", *checked(rows, "i")).join(ctx, "_row", "left")
    return placed.select("i", F.coalesce("ctx", F.array().cast("array<bigint>")).alias("ctx"), *others)
