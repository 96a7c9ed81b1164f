import pytest
from pyspark.sql import functions as F

from lexloom.operators import embedding, windows


def corpus_of(spark, n):
    return spark.createDataFrame([(i, f"w{i}", "") for i in range(n)], "pos bigint, word string, label string")


@pytest.mark.parametrize("n,ws,block", [(1, 2, 4), (3, 2, 4), (5, 2, 4), (8, 3, 4), (9, 2, 4), (25, 3, 4), (30, 3, 1000)])
def test_windows_match_a_list(spark, n, ws, block):
    found = windows.context_windows(corpus_of(spark, n), ws, n, block=block).collect()
    steps = list(range(-1, -ws - 1, -1)) + list(range(1, ws + 1))
    want = {p: [f"w{(p + o) % n}" for o in steps] for p in range(n)}
    assert {r["pos"]: r["ctx"] for r in found} == want and len(found) == n


def test_examples_share_windows_and_keep_the_tail(spark):
    n, ws, ns, batch = 47, 2, 3, 10
    corpus = corpus_of(spark, n)
    found = windows.cbow_examples(corpus, n, ws, ns, batch).collect()
    assert len(found) == n * (1 + ns) and len({r["ex_id"] for r in found}) == len(found)
    by_pos = {r["ex_id"] // (1 + ns): r for r in found if r["x"] == 1.0}
    assert all(r["i"] == f"w{p}" and r["batch_id"] == p // batch for p, r in by_pos.items())
    assert all(r["ctx"] == by_pos[r["ex_id"] // (1 + ns)]["ctx"] for r in found)
    assert windows.cbow_examples(corpus, n, ws, ns, batch, keep_tail=False).count() == 40 * (1 + ns)
    pairs = windows.generate_examples(corpus, n, "sgns", ws=ws, ns=ns, batch_size=batch)
    assert pairs.count() == n * (1 + ns) * 2 * ws
    with pytest.raises(ValueError):
        windows.generate_examples(corpus, n, "glove")


def test_negatives_follow_the_pool(spark):
    corpus = corpus_of(spark, 200)
    pool = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pos bigint, word string")
    drawn = windows.negative_samples(corpus, pool, 3, 10)
    share = drawn.where("word = 'x'").count() / drawn.count()
    assert drawn.count() == 2000 and abs(share - 2 / 3) < 0.05
    # The pool's own size counts, given or not.
    examples = windows.cbow_examples(corpus.limit(100), 100, 2, 3, pool=pool).collect()
    assert len(examples) == 400 and all(r["i"] is not None for r in examples)
    with pytest.raises(ValueError, match="empty pool"):
        windows.cbow_examples(corpus, 200, pool=pool.limit(0))


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_negatives_by_search_and_by_merge(spark, monkeypatch, kind):
    corpus = corpus_of(spark, 300)
    words = ["3"] * 150 + [str(v) for v in range(200, 250)] * 2 + ["7", "1"]
    pool = spark.createDataFrame(list(enumerate(words)), "pos bigint, word string").withColumn("word", F.col("word").cast(kind))
    ordered = sorted(words, key=int if kind == "bigint" else str)
    got = [tuple(r) for r in windows.negative_samples(corpus, pool, len(words), 5, seed=3).collect()]
    assert len(got) == 1500 and all(str(word) == ordered[drawn] for _, _, drawn, word in got)
    assert {k for _, k, _, _ in got} == {1, 2, 3, 4, 5} and len({d for _, _, d, _ in got}) > 200
    monkeypatch.setattr(windows, "RANGE_DRAWS", 100)
    merged = windows.negative_samples(corpus, pool, len(words), 5, seed=3, limit=0).collect()
    assert sorted(map(tuple, merged)) == sorted(got)


def test_negatives_add_no_shuffle(spark):
    corpus = corpus_of(spark, 300)

    def shuffles(ns):
        return windows.example_bags(corpus, 300, 2, ns, 100, centre="word", context="word")._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert shuffles(5) == shuffles(0)


def test_batches_are_shuffled_per_epoch(spark):
    corpus = corpus_of(spark, 105)
    orders = [
        tuple(r["batch_id"] for r in windows.batch_order(corpus, 10, epoch).orderBy("turn").collect())
        for epoch in range(3)
    ]
    assert all(sorted(o) == list(range(10)) for o in orders) and len(set(orders)) == 3
    assert windows.assign_batches(corpus, 105, 10).count() == 105


def test_external_examples_reject_unknown_words(spark):
    vocab = spark.createDataFrame([("a", ""), ("b", "")], "word string, label string")
    keys = embedding.build_keys_shared(vocab)
    good = spark.createDataFrame([("a", "b_c", 1.0)], "i string, j string, x double")
    row = windows.external_examples(good, keys).first()
    ix = {r["key"]: r["ix"] for r in keys.collect()}
    assert (row["i"], row["j"]) == (ix["a"], ix["b_c"])
    with pytest.raises(ValueError, match="outside the vocabulary"):
        windows.external_examples(good.withColumn("i", F.lit("zz")), keys)


def test_windows_of_small_batches_use_no_window_operator(spark):
    corpus = corpus_of(spark, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = windows.context_windows(corpus, 4, 60, block=9)
        assert "RunningWindow" not in made._jdf.queryExecution().toString() and "Window [" not in made._jdf.queryExecution().toString()
        found = made.collect()
        bags = windows.example_bags(corpus, 60, 4, 2, 10, 1, centre="word", context="word").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    steps = [-1, -2, -3, -4, 1, 2, 3, 4]
    want = {p: [f"w{(p + o) % 60}" for o in steps] for p in range(60)}
    assert {r["pos"]: r["ctx"] for r in found} == want and len(found) == 60
    assert {r["bag_id"]: r["ctx"] for r in bags} == want and all(r["targets"][0] == f"w{r['bag_id']}" for r in bags)
    drawn = {(r["pos"], r["k"]): r["word"] for r in windows.negative_samples(corpus, corpus, 60, 2, 1).collect()}
    assert all(r["targets"][k] == drawn[r["bag_id"], k] for r in bags for k in (1, 2))


def test_missing_positions_leave_gaps_as_neighbours_do(spark):
    rows = [(i, f"w{i}", "") for i in range(20) if i not in (4, 5)]
    corpus = spark.createDataFrame(rows, "pos bigint, word string, label string")
    found = {r["pos"]: r["ctx"] for r in windows.context_windows(corpus, 2, 20, block=5).collect()}
    assert len(found) == 18 and found[10] == ["w9", "w8", "w11", "w12"]
    assert found[3] == ["w2", "w1", "w6", None] and found[6] == ["w3", None, "w7", "w8"]


def test_tables_are_searched_by_the_bytes_of_their_arrays(spark):
    counts = spark.createDataFrame([(1, 5), (2, 6)], "value bigint, n bigint")
    assert windows._searchable(counts, 32) and not windows._searchable(counts, 31)
    words = spark.createDataFrame([("abc", 5)], "value string, n bigint")
    assert windows._searchable(words, 19) and not windows._searchable(words, 18)
