"""What tasks work out on arrays: draws, steps, likelihoods; and what is read or stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.catalog.inputs import r6
from lexloom.functions import hashing
from lexloom.operators import embedding, gradient, kernel, likelihood, optimise, text, windows
from lexloom.plans import scale, vi_fit


def plan_of(df):
    return df._jdf.queryExecution().toString()


def words_of(spark, rows=300):
    return spark.range(rows).select(F.col("id").alias("pos"), F.concat(F.lit("w"), (F.col("id") * 7 % 23).cast("string")).alias("word"), F.lit("").alias("label"))


def model_of(spark, corpus, dim=4):
    vocab = corpus.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    return embedding.new_embedding(vocab, dim, seed=3)


def test_draws_of_arrays_are_those_of_expressions(spark):
    ids = np.array([0, 1, 9, 10, 99, 100, 12345678, 10**9, 10**12 + 7, 10**18 - 1, 10**18, 2**63 - 1] + [*range(200, 240)], np.int64)
    rows = spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "k int, i bigint")
    found = rows.select(
        "k", hashing.uniform(5, "p", F.col("i"), F.lit(2)).alias("u"), hashing.normal(5, "p", F.lit(2), F.col("k"), F.col("i")).alias("z"), hashing.draw_index(1000, 5, "p", F.col("i")).alias("d")
    ).orderBy("k").toPandas()
    assert (found["u"].to_numpy() == hashing.uniform_array(5, "p", ids, 2)).all()
    assert (found["d"].to_numpy() == hashing.draw_index_array(1000, 5, "p", ids)).all()
    np.testing.assert_allclose(found["z"], hashing.normal_array(5, "p", 2, np.arange(len(ids)), ids), rtol=1e-12, atol=1e-15)
    assert len(hashing.uniform_array(5, "p", ids[:0])) == 0
    with pytest.raises(ValueError):
        hashing.uniform_array(5, "p", np.array([-1]))


@pytest.mark.parametrize("kind", ["word", "number"])
def test_negatives_are_drawn_by_the_task_that_makes_the_windows(spark, monkeypatch, kind):
    corpus = words_of(spark).withColumn("number", F.col("pos") * 7 % 23)
    options = {"ws": 2, "ns": 3, "batch_size": 100, "seed": 4, "centre": kind, "context": kind}
    bags = windows.example_bags(corpus, 300, **options)
    assert "md5(" not in plan_of(bags)
    monkeypatch.setattr(windows, "_searchable", lambda counts: False)
    other = windows.example_bags(corpus, 300, **options)
    assert sorted(map(tuple, bags.collect())) == sorted(map(tuple, other.collect()))


def test_steps_are_taken_on_arrays(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *([float(v) for v in rng.random(3)] for _ in range(8))) for k in range(5)]
    names = ["mean", "log_std", "mean_m", "mean_v", "std_m", "std_v", "eps", "grad"]
    state = spark.createDataFrame(rows, ", ".join(["ix bigint", *(f"{c} array<double>" for c in names)]))
    grad, state = state.select("ix", "grad"), state.drop("grad")
    moved = vi_fit.variational_step(state, grad, 2)
    plain = optimise.adam_step(state.select("ix", F.col("mean").alias("vec"), F.col("mean_m").alias("m"), F.col("mean_v").alias("v")), grad, 2)
    for df in (moved, plain, embedding.init_vectors(state.select("ix"), 3), vi_fit.init_variational(embedding.EmbeddingModel(state, state, 3))):
        assert "lambdafunction" not in plan_of(df)
    got = {r["ix"]: r for r in moved.collect()}
    same = {r["ix"]: r for r in plain.collect()}
    adam = optimise.Adam()
    for ix, mean, log_std, mean_m, mean_v, std_m, std_v, eps, g in rows:
        for value, m, v, by, out in ((mean, mean_m, mean_v, g, "mean"), (log_std, std_m, std_v, np.array(g) * np.exp(log_std) * eps + 1, "log_std")):
            m, v = (0.9 * np.array(m) + (1 - 0.9) * np.array(by), 0.999 * np.array(v) + (1 - 0.999) * np.array(by) ** 2)
            want = value + adam.learning_rate * (m / (1 - 0.9**2)) / (np.sqrt(v / (1 - 0.999**2)) + adam.epsilon)
            np.testing.assert_allclose(got[ix][out], want, rtol=1e-12)
        assert same[ix]["vec"] == got[ix]["mean"] and same[ix]["m"] == got[ix]["mean_m"]


def test_a_likelihood_sends_only_what_it_needs(spark):
    corpus = words_of(spark)
    model = model_of(spark, corpus)
    bags = windows.example_bags(embedding.encode_corpus(model, corpus), 300, 2, 2, 100, 1)
    each = scale.materialise(bags.select("bag_id", "ctx", F.inline(F.arrays_zip(F.col("targets").alias("i"), "x"))))
    pairs = each.select("bag_id", "i", F.explode("ctx").alias("j"), F.when(F.col("bag_id") % 5 > 0, F.col("x")).alias("x"))
    for score, rows, near in ((likelihood.cbow_log_likelihood, each, "ctx"), (likelihood.sgns_log_likelihood, pairs, "j")):
        found, other = score(rows, model.theta, 4), score(rows, model.theta, 4, "blocks")
        assert "MapInArrow" not in plan_of(found) and "ArrowEvalPython" in plan_of(found) and found.columns == other.columns

        def values(df):
            some = df.groupBy("bag_id", "i", F.col(near).cast("string"), "x").agg(F.sum("log_lik").alias("s"), F.count("log_lik").alias("n"))
            return sorted((str(r[:4]), round(r["s"] or 0, 9), r["n"]) for r in some.collect())

        assert values(found) == values(other)
    assert found.where("x is null").count() == found.where("log_lik is null").count() > 0


def test_pairs_are_bags_without_lists(spark, monkeypatch):
    model = model_of(spark, words_of(spark))
    pairs = spark.range(500).select((F.col("id") % 23).alias("i"), (23 + F.col("id") * 5 % 23).alias("j"), (F.col("id") % 3 == 0).cast("double").alias("x"))
    plain = gradient.pairs_as_bags(pairs, plain=True)
    assert dict(plain.dtypes)["targets"] == "bigint"

    def sums(bags):
        return {r["ix"]: np.round(r["vec"], 9).tolist() for r in gradient.likelihood_gradient(model, bags, "sgns").collect()}

    want = sums(gradient.pairs_as_bags(pairs))
    assert sums(plain) == want
    monkeypatch.setattr(kernel, "THETA_BYTES", 0)
    assert sums(plain) == want


def test_supplied_examples_are_read_twice(spark):
    corpus = words_of(spark)
    keys = model_of(spark, corpus).keys
    seen = spark.sparkContext.accumulator(0)

    def see(word):
        seen.add(1)
        return word

    pairs = corpus.select(F.udf(see)("word").alias("i"), F.concat("word", F.lit("_c")).alias("j"), F.lit(1.0).alias("x"))
    assert len(windows.external_examples(pairs, keys).collect()) == 300 and seen.value <= 600
    for wrong in ("i", "j"):
        with pytest.raises(ValueError, match="outside the vocabulary"):
            windows.external_examples(pairs.withColumn(wrong, F.lit(None).cast("string")), keys)


def test_a_lookup_joins_the_requests_once(spark, monkeypatch):
    corpus = words_of(spark)
    model = model_of(spark, corpus)
    asked = corpus.select("pos", F.col("word").alias("key"))
    found = embedding.lookup_vectors(model, asked)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    rows = sorted(map(tuple, found.collect()), key=str)
    assert len(rows) == 300 and found.columns == ["ix", "pos", "key", "vec"]
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, embedding.lookup_vectors(model, asked).collect()), key=str) == rows


def test_placed_tokens_are_stored_without_what_ordered_them(spark):
    tokens = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("tok"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string")).alias("word"))
    corpus = text.preprocess_standard(tokens, ["doc_id", "tok"], limit=1, downsample=False).corpus
    assert set(spark.read.parquet(*corpus.inputFiles()).columns) == {"word", "label", "_part", "_row"}
    assert [(r["pos"], r["word"]) for r in corpus.orderBy("pos").collect()] == [(k, f"w{k % 9}") for k in range(400)]


def test_few_folders_are_written_without_a_sort(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("part"))
    few = scale.materialise(rows, "few", ["part"], few=True)
    many = scale.materialise(rows, "many", ["part"])
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    one = spark.read.parquet(few.inputFiles()[0].rpartition("/")[0])
    assert one.count() in (333, 334) and spark.conf.get(scale.WRITERS, None) in (None, "0")


def test_rounding_is_that_of_decimal_numbers(spark):
    odd = [0.5e-6, 1.5e-6, -2.5e-6, 1.0000005, 0.1234565, -0.1234575, 1e9 + 0.1234565, 1e15 + 0.3, 1e300, -0.0, 0.0, float("nan"), float("inf"), None, 5e-7 - 1e-20, 1e-300]
    values = odd + [float(v) for v in np.random.default_rng(0).normal(size=3000)] + [k / 2e6 for k in range(-500, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    both = rows.select("x", r6(F.col("x")).alias("got"), (F.round("x", 6) + F.lit(0.0)).alias("want"))
    assert both.where("not (got <=> want)").collect() == []
    assert "rint" in plan_of(rows.select(r6("x"))).lower()
