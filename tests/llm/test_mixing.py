from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing
from lexloom.llm.common import word_count


def docs_of(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")


def brute_targets(sizes):
    """Reshare the excess over and over until no target is above its cap."""
    total = defaultdict(int)
    for s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        rest = budget - sum(2 * total[s] for s in full)
        live = sum(weight[s] for s in order if s not in full)
        share = {s: 2.0 * total[s] if s in full else weight[s] * rest / live for s in order}
        over = {s for s in order if share[s] > 2 * total[s] + 1e-9}
        if not over:
            return total, share
        full |= over


def test_targets_taken_and_reruns(spark):
    sizes = [("hot", 10 + i % 7) for i in range(3000)] + [(s, 5 + i % 11) for i in range(600) for s in ("a", "b", None, "ü")]
    total, want = brute_targets(sizes)
    df = docs_of(spark, sizes)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(n for x, n in sizes if x == s)
    again = mixing.mix(df.repartition(7), blocks=300).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_positions_follow_the_integrated_schedule(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.4, 0.0), (1.0, 2.0))):
        demand = spark.range(1, 100).select((F.col("id") / 100).alias("d"))
        got = demand.select("d", mixing.training_position(F.col("d"), mixing._segments(schedule)).alias("t")).collect()
        area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
        for r in got:
            filled = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                x = min(max(r.t - t0, 0.0), t1 - t0)
                filled += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert filled / sum(area) == pytest.approx(r.d, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.segments(((0.0, 0.0), (1.0, 0.0)))


def test_odd_rows_and_clashing_columns(odd_docs, no_docs):
    got = mixing.mixed_documents(odd_docs)
    assert got.columns == odd_docs.columns
    sized = odd_docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized)
    assert mixed.count() == odd_docs.count()
    assert mixed.where("size = 0 AND taken <> 0").count() == 0
    assert got.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(no_docs).count() == 0
    blank = odd_docs.where("doc_id IN (3, 4, 5)")
    assert mixing.mixed_documents(blank).count() == 0
