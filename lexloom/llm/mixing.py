"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source gets a share of the token budget by weight, capped at a multiple of its own
size, with the excess shared out again by weight until no source is above its cap. A source's documents
lie on an axis of cumulative words in the order of a hash; the axis is repeated once per pass, and a
document is taken in every pass in which its middle lies before the target. So the words taken miss
the target by at most half of one document, and no document is taken more often than the cap allows.

The curriculum: every source has a weight schedule over training time 0 to 1, linear between knots.
Its integral, scaled to one, is the source's cumulative demand; inverting it at a document's place on the
axis gives the document's training position. ``mixed_documents`` repeats the documents as taken and
range-sorts them by position.

Defined cases: null and empty texts have size 0 and are taken zero times over (``taken`` 0); a null source
is a source of its own and comes last; documents with equal hash, id and size follow each other in any
order; an empty table gives an empty result. ``mix`` carries extra columns along, but not under the names of its
results or beginning with ``_mix``; ``mixed_documents`` carries columns of any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import hashing
from lexloom.llm.common import let, word_count
from lexloom.plans import scale

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
# Weight schedules (time, weight) by a source's place in the weight cycle: falling, level, rising.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.75, 1.0), (1.0, 2.0)),
)


def shared_targets(sources: DataFrame, budget: float, most: int) -> DataFrame:
    """Add ``target`` to ``(.., source_size, weight)``: weighted shares, capped, the excess reshared.

    Each round fills the sources that the current rate per weight would overfill and computes the rate
    for the others; the filled set only grows, so it ends. A round is one sum over the sources.
    """
    cap = F.col("source_size") * most
    demand = cap / F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, filled = 0.0, -1
    while True:
        full = F.lit(False) if filled < 0 else demand <= F.lit(rate)
        n, gone, left = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)),
            F.sum(F.when(full, cap).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        if n is None or n == filled or not left:
            break
        filled, rate = n, (budget * total - gone) / left
    return sources.withColumn(
        "target",
        F.when(demand <= F.lit(rate), cap.cast("double")).otherwise(F.col("weight") * F.lit(rate)),
    )


def segments(schedule: Sequence[tuple[float, float]]) -> list[dict[str, float]]:
    """The schedule's pieces with the integral up to their start; the whole integral is one."""
    spans = list(zip(schedule, schedule[1:], strict=False))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in spans]
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or min(w for _, w in schedule) < 0 or sum(areas) <= 0:
        raise ValueError(f"a schedule runs from time 0 to 1 with a positive integral, got {schedule}")
    whole, before, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(spans, areas, strict=True):
        if area > 0:
            out.append({"start": float(t0), "w0": w0 / whole, "slope": (w1 - w0) / (t1 - t0) / whole, "low": before / whole})
        before += area
    return out


def _segments(schedule: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in segments(schedule)])


def training_position(demand: Column, schedule: Column) -> Column:
    """Time at which the cumulative demand of ``schedule`` (from ``_segments``) reaches ``demand``."""

    def inside(s: Column) -> Column:
        need = F.greatest(demand - s["low"], F.lit(0.0))
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * need, F.lit(0.0)))
        # The form of the root that stays accurate when the slope is zero.
        return s["start"] + F.when(need == 0, 0.0).otherwise(2 * need / (s["w0"] + root))

    reached = F.filter(schedule, lambda s: s["low"] <= demand)
    return F.least(F.lit(1.0), let(F.element_at(reached, -1), inside))


def mix(
    docs: DataFrame,
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 9,
    blocks: int | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``source_size, target, copies, taken`` and the ``positions`` of its copies.

    A source's axis is laid out in blocks by hash: sizes are summed per block, the block sums are
    accumulated, and a window only ever spans one block, so a source with a third of all rows is spread.
    """
    # 's' and the source; null is the empty string. Keeps joins and windows on one plain key.
    named = docs.withColumn("_mix_source", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source"))))
    sums = named.groupBy("_mix_source").agg(F.sum(size).cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = scale.materialise(sums, "mix-sources")
    order = [F.when(F.col("_mix_source") == "", 1).otherwise(0).alias("late"), "_mix_source"]
    ranked = scale.dense_index(sums.select("*", order[0]), ["late", "_mix_source"], "rank").drop("late")
    cycle = (F.col("rank") % len(weights)).cast("int")
    weighed = ranked.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), cycle))
    weighed = shared_targets(scale.materialise(weighed, "mix-weights"), budget, most)
    plans = F.array(*[_segments(s) for s in schedules])
    weighed = weighed.withColumn("plan", F.get(plans, (F.col("rank") % len(schedules)).cast("int")))

    if blocks is None:
        rows = sums.agg(F.sum("n")).first()[0] or 0
        blocks = max(256, rows // 100_000)
    hashed = named.withColumn("_mix_hash", hashing.uniform(seed, "mix", F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hashed = hashed.withColumn("_mix_block", F.floor(F.col("_mix_hash") * blocks).cast("int"))
    block_sums = hashed.groupBy("_mix_source", "_mix_block").agg(F.sum(size).alias("block_size"))
    earlier = W.partitionBy("_mix_source").orderBy("_mix_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = block_sums.withColumn("offset", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    offsets = offsets.join(weighed, "_mix_source").select(
        "_mix_source", "_mix_block", "offset", "source_size", "target", "plan"
    )
    inside = W.partitionBy("_mix_source", "_mix_block").orderBy("_mix_hash", key, size)
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = hashed.withColumn("_mix_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = placed.join(offsets, ["_mix_source", "_mix_block"])

    middle = F.col("offset") + F.col("_mix_before") + F.col(size) / 2.0
    middles = F.transform(
        F.array(*[F.lit(k) for k in range(most)]), lambda k: middle + k * F.col("source_size")
    )
    taken = F.filter(middles, lambda m: (m < F.col("target")) & (F.col(size) > 0))
    positions = F.transform(taken, lambda m: training_position(m / F.col("target"), F.col("plan")))
    return (
        placed.withColumn("positions", positions)
        .withColumn("copies", F.size("positions"))
        .withColumn("taken", F.col("copies") * F.col(size))
        .select(*docs.columns, "source_size", "target", "copies", "taken", "positions")
    )


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents as the mix takes them, repeats as repeated rows, in the order of training position."""
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.struct(*docs.columns).alias("doc"))
    mixed = mix(sized, **options).select("doc", F.explode("positions").alias("position"))
    return mixed.orderBy("position", F.xxhash64("doc.doc_id")).select("doc.*")
