"""What grows with the tables: separators, draws, vectors that are moved, rows that are shuffled."""

import numpy as np
from pyspark.sql import functions as F

from lexloom.functions import hashing
from lexloom.functions import text as text_functions
from lexloom.operators import embedding, gradient, kernel, text, windows
from lexloom.plans import scale
from lexloom.streaming import partial_fit


def plan_of(df):
    return df._jdf.queryExecution().toString()


def bags_of(spark, rows=400, names=50):
    rng = np.random.default_rng(3)
    made = [(int(k), [int(v) for v in rng.integers(0, names, 3)], [1.0, 0.0, 0.0], [int(v) for v in rng.integers(0, names, 4)]) for k in range(rows)]
    return spark.createDataFrame(made, "bag_id bigint, targets array<bigint>, x array<double>, ctx array<bigint>")


def theta_of(spark, names=50, dim=4):
    return scale.materialise(spark.range(names).select(F.col("id").alias("ix"), F.array(*[(F.col("id") % (d + 7)) / 10.0 for d in range(dim)]).alias("vec")))


def test_every_separator_splits_and_the_matcher_gives_up_early(spark):
    separators = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    rows = [(f"{s}a{s}{s}é!~\u200b{s}",) for s in separators] + [("",), (" ",)]
    found = spark.createDataFrame(rows, "t string").select(text_functions.split_words(F.col("t")).alias("w"))
    assert [r["w"] for r in found.collect()] == [["a", "é!~\u200b"]] * len(separators) + [[], []]
    assert "[^!-~]&&" in plan_of(found)


def test_few_characters_are_stripped_without_a_look_at_each(spark):
    rows = spark.createDataFrame([("a.b,c!?é..",), ("abc",), ("?!",), (None,)], "t string").select(text_functions.strip_characters(F.col("t")).alias("w"))
    assert [r["w"] for r in rows.collect()] == ["abcé", "abc", "", None]
    assert "translate(" not in plan_of(rows)


def test_words_that_are_always_kept_draw_nothing(spark):
    tokens = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("tok"), F.when(F.col("id") < 1900, "much").otherwise(F.concat(F.lit("r"), (F.col("id") % 20).cast("string"))).alias("word"))
    counts = scale.materialise(text.word_counts(tokens))
    thin = text.downsample_common_words(tokens, counts, ["doc_id", "tok"], 0.01, 3)
    found = {r["word"]: r["count"] for r in thin.groupBy("word").count().collect()}
    assert all(found[f"r{k}"] == 5 for k in range(20)) and 0 < found["much"] < 1900
    assert ">= 1.0" in plan_of(thin)


def test_a_text_is_split_once_and_a_word_stripped_once(spark):
    rows = [(1, "B. a!", "x"), (2, None, "x"), (None, " ", "y"), (3, "", None), (4, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    tokens = text.tokenize(docs, ["doc_id"], label="label", lowercase=False)
    assert sorted(map(tuple, tokens.collect()), key=str) == [(1, 0, "B.", "x"), (1, 1, "a!", "x"), (4, 0, "c", None)]
    stripped = text.strip_punctuation(text.lowercase_tokens(tokens))
    found = text.word_counts(stripped).join(spark.createDataFrame([("b",)], "word string"), "word")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("lower(") == 1
    assert [tuple(r) for r in found.collect()] == [("b", 1)]


def test_draws_are_compared_with_a_bar_as_with_a_chance(spark):
    exact = [k / 2.0**48 for k in (0, 1, 2**20 + 1, 2**47, 2**48 - 1, 2**48)]
    drawn = [r["u"] for r in spark.range(40).select(hashing.uniform(3, "p", F.col("id")).alias("u")).collect()]
    near = [c for u in drawn for c in (u, np.nextafter(u, 0.0), np.nextafter(u, 1.0))]
    chances = spark.createDataFrame([(float(c),) for c in [*exact, *near, np.nextafter(1.0, 0.0), 1e-5, 0.3]], "c double")
    both = chances.crossJoin(spark.range(40)).select(
        (hashing.uniform(3, "p", F.col("id")) < F.col("c")).alias("was"),
        hashing.happens(hashing.chance_bar(F.col("c")), 3, "p", F.col("id")).alias("now"),
    )
    assert both.where("was <> now or now is null").count() == 0 and both.where("now").count() > 0


def test_no_number_is_made_of_a_draw_to_thin_tokens(spark):
    tokens = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("tok"), F.concat(F.lit("w"), F.floor(F.sqrt("id"))).alias("word"))
    counts = scale.materialise(text.word_counts(tokens))
    thin = text.downsample_common_words(tokens, counts, ["doc_id", "tok"], 0.001, 3)
    assert "conv(" not in plan_of(thin) and thin.columns == ["word", "doc_id", "tok"]
    joined = tokens.join(counts, "word")
    keep = text.keep_probability(F.col("n"), 3000, 0.001)
    want = joined.where(hashing.uniform(3, "downsample", F.col("doc_id"), F.col("tok")) < keep).select(*thin.columns)
    assert 0 < want.count() < 3000 and sorted(thin.collect()) == sorted(want.collect())


def test_draws_written_out_are_those_of_the_loop(spark, monkeypatch):
    corpus = spark.range(300).select(F.col("id").alias("pos"), F.concat(F.lit("w"), (F.col("id") % 17).cast("string")).alias("word"))
    found = windows.negative_samples(corpus, corpus, 300, 4, 5)
    assert "lambdafunction" not in plan_of(found)
    monkeypatch.setattr(windows, "WRITTEN_OUT", 0)
    loop = windows.negative_samples(corpus, corpus, 300, 4, 5)
    assert sorted(found.collect()) == sorted(loop.collect()) and found.schema == loop.schema


def test_pairs_are_counted_where_their_centre_is(spark):
    corpus = spark.range(500).select(F.col("id").alias("pos"), F.concat(F.lit("w"), (F.col("id") * 7 % 23).cast("string")).alias("word"), F.lit("").alias("label"))
    options = {"ws": 2, "ns": 2, "batch_size": 100, "seed": 1}

    def counted(**more):
        return windows.generate_examples(corpus, 500, "sgns", **options, **more).groupBy("i", "j", "x").count()

    found = counted(by_centre=True)
    executed = found._jdf.queryExecution().executedPlan().toString()
    before = executed[: executed.index("Generate explode")]
    assert "Exchange" not in before
    assert sorted(found.collect()) == sorted(counted().collect())


def test_vectors_are_broadcast_by_their_own_bytes(spark, monkeypatch):
    bags, theta = bags_of(spark), theta_of(spark)
    model = embedding.EmbeddingModel(theta, theta, 4)
    monkeypatch.setattr(kernel, "THETA_BYTES", 50 * 4 * 8)
    assert "CoGroup" not in plan_of(gradient.likelihood_gradient(model, bags, "cbow"))
    monkeypatch.setattr(kernel, "THETA_BYTES", 50 * 4 * 8 - 1)
    assert "CoGroup" in plan_of(gradient.likelihood_gradient(model, bags, "cbow"))


def test_gradients_of_many_vectors_are_summed_in_few_tasks(spark, monkeypatch):
    bags, theta = scale.materialise(bags_of(spark).repartition(40)), theta_of(spark)
    monkeypatch.setattr(kernel, "FEW_BYTES", 0)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        needed = bags.select("targets", "x", "ctx")
        assert needed.rdd.getNumPartitions() == 40
        found = kernel.over_bags(needed, theta, 4, "cbow", kernel.Gradient, kernel.GRADIENT)
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert found.agg(F.sum("n")).first()[0] == 1200
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_block_pulls_a_vector_once_whatever_the_batches(spark):
    bags = bags_of(spark).withColumn("_block", F.floor(F.col("bag_id") / 150).cast("bigint")).coalesce(1).sortWithinPartitions("bag_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = [tuple(r) for r in kernel._touched(bags).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = bags.select("_block", F.explode(F.concat("targets", "ctx"))).distinct().collect()
    assert sorted(found) == sorted(map(tuple, every))


def test_a_stream_stores_pairs_and_no_lists(spark, tmp_path, monkeypatch):
    theta = theta_of(spark)
    pairs = spark.range(100).select((F.col("id") % 50).alias("i"), (F.col("id") * 3 % 50).alias("j"), F.lit(1.0).alias("x"))
    stored, own = [], scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda df, *a, **k: stored.append(df.columns) or own(df, *a, **k))
    model = embedding.EmbeddingModel(theta, theta, 4)
    partial_fit.partial_fit_batch(model, pairs, 0, str(tmp_path / "f"), 100)
    assert ["i", "j", "x"] in stored and not [c for c in stored if "targets" in c]
    assert partial_fit.steps(spark, str(tmp_path / "f")).first()["n"] == 100


def test_gradients_meet_as_slabs(spark, monkeypatch):
    monkeypatch.setattr(kernel, "SLAB_NUMBERS", 28)
    theta = theta_of(spark)
    model, bags = embedding.EmbeddingModel(theta, theta, 4), scale.materialise(bags_of(spark).repartition(5))
    for kind in ("cbow", "sgns"):
        found = gradient.likelihood_gradient(model, bags, kind)
        assert "FlatMapGroupsInArrow" in plan_of(found) and "sum(vec" not in plan_of(found)
        other = {r["ix"]: r["vec"] for r in gradient.likelihood_gradient(model, bags, kind, "blocks").collect()}
        rows = found.collect()
        assert len(rows) == len(other) == 50
        assert all(np.allclose(r["vec"], other[r["ix"]], atol=1e-9) for r in rows)


def test_tokens_and_shuffles_go_when_they_have_been_written(spark, tmp_path):
    import os
    import time

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString(" ").split() if "shuffle_" in name}

    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        rows = [(d, k, f"w{(d * k) % 9}") for d in range(20) for k in range(30)]
        tokens = spark.createDataFrame(rows, "doc_id bigint, tok int, word string")
        made = text.preprocess_standard(tokens, ["doc_id", "tok"], limit=1, downsample=False)
        assert sorted(r["pos"] for r in made.corpus.collect()) == list(range(600))
        assert not [n for n in os.listdir(tmp_path) if n.startswith("kept-tokens")]
        before = shuffles()
        stored = scale.materialise(spark.range(5000).repartition(7, "id"), "shuffled")
        # What it shuffled goes soon after; without the setting it stays until Spark's collector runs.
        for _ in range(50):
            if not [n for n in shuffles() - before if n.endswith(".data")]:
                break
            time.sleep(0.2)
        assert not [n for n in shuffles() - before if n.endswith(".data")]
        assert spark.conf.get(scale.CLEANUP, None) in (None, "false") and stored.count() == 5000
    finally:
        spark.conf.unset(scale.SCRATCH)


def test_neighbours_are_those_of_a_document_and_of_a_repeated_id(spark, tmp_path):
    from lexloom.catalog import model_queries

    docs = [(1, "a b  c"), (2, "A"), (3, None), (None, "x y"), (4, "p q r"), (4, "s t"), (5, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = [(d, k, w) for d, t in docs if d is not None and t for k, w in enumerate(t.lower().split())]
    want = {(a, b) for d, k, a in tokens for e, m, b in tokens if d == e and m == k + 1}
    found = [tuple(r) for r in model_queries._neighbours(spark, str(tmp_path)).collect()]
    assert set(found) == want and len(found) == len(want) and ("p", "t") in want
