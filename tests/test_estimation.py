import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import embedding, gradient, graph, holdout, kernel, likelihood, optimise, priors, text, windows
from lexloom.plans import map_fit, scale, training, vi_fit
from lexloom.streaming import partial_fit

SIZE, WS, NS = 840, 2, 2


@pytest.fixture(scope="module")
def model(spark, text_corpus):
    return embedding.new_embedding(text_corpus.select("word", "label").distinct(), 6, seed=4)


@pytest.fixture(scope="module")
def bags(model, text_corpus):
    encoded = embedding.encode_corpus(model, text_corpus)
    return scale.materialise(windows.example_bags(encoded, SIZE, WS, NS, SIZE), "bags")


def examples_of(bags):
    each = bags.select("bag_id", "ctx", F.posexplode(F.arrays_zip("targets", "x")))
    return each.select(
        (F.col("bag_id") * 10 + F.col("pos")).alias("ex_id"), F.lit(0).alias("batch_id"),
        F.col("col.targets").alias("i"), "ctx", F.col("col.x").alias("x"),
    )


def array_of(df, column):
    rows = df.select("ix", column).orderBy("ix").collect()
    return np.array([r[column] for r in rows])


@pytest.mark.parametrize("kind", ["cbow", "sgns"])
def test_gradient_plans_agree_with_finite_differences(spark, model, bags, kind):
    wide = model.with_theta(scale.materialise(model.theta.select("ix", F.transform("vec", lambda x: x * 8).alias("vec"))))
    one, two = (array_of(gradient.posterior_gradient(wide, bags, kind, 0.7, p), "grad") for p in ("broadcast", "blocks"))
    assert np.allclose(one, two, atol=1e-9)
    data = [(r["targets"], r["x"], r["ctx"]) for r in bags.collect()]

    def log_posterior(theta):
        total = -0.7 * 0.5 * (theta**2).sum()
        for targets, x, ctx in data:
            z = theta[targets] @ theta[ctx].T
            z = z if kind == "sgns" else z.sum(axis=1, keepdims=True)
            total -= np.logaddexp(0, -(2 * np.array(x)[:, None] - 1) * z).sum()
        return total

    theta = array_of(wide.theta, "vec")
    for row, d in [(0, 0), (3, 5), (len(theta) - 1, 2)]:
        step = np.zeros_like(theta)
        step[row, d] = 1e-5
        slope = (log_posterior(theta + step) - log_posterior(theta - step)) / 2e-5
        assert abs(slope - one[row, d]) < 1e-4 * max(1, abs(slope))
    examples = examples_of(bags)
    examples = windows.sgns_pairs(examples) if kind == "sgns" else examples
    found = likelihood.log_posterior(wide, examples, kind, 7, 10).first()
    assert np.isclose(found["log_posterior"], log_posterior(theta))
    mean = gradient.bag_log_likelihood(wide, bags, kind).first()
    assert np.isclose(mean["value"] * mean["n"], found["log_lik"]) and mean["n"] == found["n"]


def test_graph_prior_gradient(spark, model):
    edges = spark.createDataFrame([("cat", "dog", 2.0), ("cat", "cat", 5.0)], "key1 string, key2 string, weight double")
    held = embedding.new_embedding(model.keys.where("role = 'w'").select("word", "label"), 6, edges=edges, lambda1=3.0)
    v = {r["key"]: np.array(r["vec"]) for r in held.vectors().collect()}
    ix = {r["key"]: r["ix"] for r in held.keys.collect()}
    got = {r["ix"]: np.array(r["vec"]) for r in gradient.prior_gradient(held, 0.5).collect()}
    assert np.allclose(got[ix["cat"]], -0.5 * (v["cat"] + 3.0 * 2.0 * (v["cat"] - v["dog"])))
    assert np.allclose(got[ix["fish"]], -0.5 * v["fish"])


def test_edges_by_word_label_and_role(spark):
    vocab = spark.createDataFrame([("vitamin", ""), ("vitamin_c", ""), ("b", "x")], "word string, label string")
    named = "word1 string, label1 string, role1 string, word2 string, label2 string, role2 string, weight double"
    edges = spark.createDataFrame([("vitamin_c", "", "w", "vitamin", "", "c", 2.0), ("b", "x", "w", "b", "y", "w", 1.0)], named)
    held = embedding.new_embedding(vocab, 3, edges=edges)
    ix = {(r["word"], r["label"], r["role"]): r["ix"] for r in held.keys.collect()}
    ends = sorted([ix["vitamin_c", "", "w"], ix["vitamin", "", "c"]])
    assert [tuple(r) for r in held.edges.collect()] == [(*ends, 2.0)]
    assert [tuple(r) for r in graph.filter_edges(edges, held.keys)[1].collect()] == [("b", "y", "w")]


class QuarticPrior:
    """Not one of the library's: the negative sum of the fourth powers."""

    def log_prob(self, theta, dim):
        return theta.agg((-F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x * x * x))).alias("log_prob"))

    def gradient(self, theta, dim):
        return theta.select("ix", F.transform("vec", lambda x: -4 * x * x * x).alias("vec"))


def test_a_prior_of_ones_own(spark, text_corpus, bags):
    own = embedding.new_embedding(text_corpus.select("word", "label").distinct(), 6, seed=4, prior=QuarticPrior())
    assert isinstance(own.active_prior, priors.Prior)
    theta = array_of(own.theta, "vec")
    assert np.isclose(likelihood.log_prior(own, 1, 4).first()[0], -0.25 * (theta**4).sum())
    grad = array_of(gradient.posterior_gradient(own, bags.limit(0), "cbow", 0.25), "grad")
    assert np.allclose(grad, -(theta**3))
    fit = map_fit.map_estimate(own, text_corpus, ws=WS, ns=NS, batch_size=SIZE, epochs=1)
    vi = vi_fit.mean_field_vi(own, text_corpus, ws=WS, ns=NS, batch_size=SIZE, epochs=1)
    assert fit.model.prior is own.prior and vi_fit.elbo_history(vi).count() == 1


@pytest.mark.parametrize("kind", ["cbow", "sgns"])
def test_blocks_give_what_the_broadcast_gives(spark, monkeypatch, model, text_corpus, bags, kind):
    wide = model.with_theta(scale.materialise(model.theta.select("ix", F.transform("vec", lambda x: x * 8).alias("vec"))))

    def everything():
        each = holdout.holdout_per_example(wide, text_corpus, kind, WS, NS)
        fit = map_fit.map_estimate(wide, text_corpus, kind=kind, ws=WS, ns=NS, batch_size=300, epochs=1)
        return [
            array_of(gradient.posterior_gradient(wide, bags, kind, 0.7), "grad"),
            np.array(sorted(r["value"] for r in each.collect())),
            np.array(holdout.holdout_accuracy(wide, text_corpus, kind, WS, NS).first()),
            np.array(holdout.holdout_likelihood(wide, text_corpus, kind, WS, NS).first()),
            array_of(fit.model.theta, "vec"),
        ]

    one = everything()
    monkeypatch.setattr(kernel, "THETA_BYTES", 0)
    monkeypatch.setattr(kernel, "BLOCK_BYTES", 8 * 6 * 50)  # a few bags
    blocks = kernel.in_blocks(bags, 6)
    sizes = blocks.groupBy("_block").agg(F.sum(F.size("targets") + F.size("ctx")).alias("n")).collect()
    assert len(sizes) > 50 and max(r["n"] for r in sizes) < 50 + 2 * WS + 1 + NS
    for a, b in zip(one, everything(), strict=True):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-9)
    plan = gradient.likelihood_gradient(wide, bags, kind)._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "BroadcastHashJoin [i#" not in plan


def test_bags_of_odd_shapes(spark, model):
    rows = [(0, [1, 2], [1.0, 0.0], []), (1, [3], [1.0], [2, 2, 5]), (2, [], [], [1])]
    odd = spark.createDataFrame(rows, "bag_id bigint, targets array<bigint>, x array<double>, ctx array<bigint>")
    theta = array_of(model.theta, "vec")
    for plan in kernel.PLANS:
        got = {r["bag_id"]: r["z"] for r in kernel.with_logits(odd, model.theta, 6, "cbow", plan).collect()}
        assert got[0] == [0.0, 0.0] and got[2] == [] and np.isclose(got[1][0], theta[3] @ (2 * theta[2] + theta[5]))
        none = kernel.totals(odd.limit(0), model.theta, 6, "sgns", plan).first()
        assert none["n"] == 0
    unknown = spark.createDataFrame([(0, [999], [1.0], [1])], odd.schema)
    with pytest.raises(Exception, match="does not have|out of bounds"):
        kernel.with_logits(unknown, model.theta, 6, "cbow", "blocks").collect()


def test_adam_second_step(spark):
    state = spark.createDataFrame([(0, [1.0], [0.1], [0.2])], "ix bigint, vec array<double>, m array<double>, v array<double>")
    grad = spark.createDataFrame([(0, [0.5])], "ix bigint, grad array<double>")
    row = optimise.adam_step(state, grad, 2).first()
    m, v = 0.9 * 0.1 + 0.1 * 0.5, 0.999 * 0.2 + 0.001 * 0.25
    moved = 1.0 + 0.001 * (m / (1 - 0.9**2)) / (np.sqrt(v / (1 - 0.999**2)) + 1e-7)
    assert np.isclose(row["vec"][0], moved) and np.isclose(row["m"][0], m) and np.isclose(row["v"][0], v)


def test_map_raises_the_log_posterior(spark, model, text_corpus, bags):
    adam = optimise.Adam(learning_rate=0.05)
    valid = text.contiguous_split(text_corpus, SIZE)[1]
    fit = map_fit.map_estimate(
        model, text_corpus, ws=WS, ns=NS, batch_size=SIZE // 2, epochs=3, adam=adam, valid=valid, early_stopping=True
    )
    examples = examples_of(bags)
    before, after = (
        likelihood.log_posterior(m, examples, "cbow", SIZE, SIZE).first()["log_posterior"] for m in (model, fit.model)
    )
    assert after > before
    scores = [r["value"] for r in fit.history.where("metric = 'validation_log_lik'").orderBy("epoch").collect()]
    assert len(scores) == 4 and scores[-1] > scores[0]
    history = map_fit.training_history(fit).orderBy("epoch").collect()
    assert [r["batches"] for r in history] == [2, 2, 2] and history[-1]["mean_loss"] < history[0]["mean_loss"]
    value = holdout.holdout_likelihood(fit.model, text_corpus, kind="cbow", ws=WS, ns=NS).first()["value"]
    share = holdout.holdout_accuracy(fit.model, text_corpus, kind="sgns", ws=WS, ns=NS).first()["value"]
    assert value < 0 and 0 < share < 1


def test_map_from_supplied_examples(spark, model):
    pairs = spark.range(600).select(
        F.pmod("id", F.lit(5)).alias("i"), F.pmod(F.col("id") * 7, F.lit(9)).alias("j"),
        (F.col("id") % 4 == 0).cast("double").alias("x"),
    )
    fit = map_fit.map_estimate(model, examples=pairs, size=600, kind="sgns", batch_size=250, epochs=1)
    assert fit.history.agg(F.sum("n")).first()[0] == 600


def test_argument_checks(spark, model, text_corpus):
    with pytest.raises(ValueError, match="either a corpus"):
        map_fit.map_estimate(model)
    with pytest.raises(ValueError, match="size"):
        map_fit.map_estimate(model, examples=text_corpus)
    with pytest.raises(ValueError, match="sgns"):
        map_fit.map_estimate(model, text_corpus, kind="glove")
    with pytest.raises(ValueError, match="no batch"):
        map_fit.map_estimate(model, text_corpus, batch_size=10_000, keep_tail=False)
    with pytest.raises(ValueError, match="outside the vocabulary"):
        map_fit.map_estimate(model, text_corpus.withColumn("word", F.lit("zebra")), batch_size=10)


def test_variational_fit(spark, model, text_corpus):
    fixed = ["the", "house", "cat", "dog", "in"]
    fit = vi_fit.mean_field_vi(
        model, text_corpus, ws=WS, ns=NS, batch_size=SIZE // 2, epochs=2, init_std=0.2, words_to_fix_rotation=fixed
    )
    means = {r["key"]: r["vec"] for r in fit.mean.vectors().collect()}
    stds = {r["key"]: r["vec"] for r in fit.std.vectors().collect()}
    for k, word in enumerate(fixed):
        assert means[word][k + 1 :] == [0.0] * (5 - k) and np.allclose(stds[word][k + 1 :], np.exp(-10))
    assert all(0.1 < s < 0.3 for s in stds["cat_c"])
    elbos = [r["elbo"] for r in vi_fit.elbo_history(fit).orderBy("epoch").collect()]
    assert len(elbos) == 2 and all(np.isfinite(elbos))
    with pytest.raises(ValueError, match="5 words"):
        vi_fit.mean_field_vi(model, text_corpus, batch_size=10, words_to_fix_rotation=["the"])


def test_posterior_samples_follow_mean_and_spread(spark):
    q = spark.createDataFrame([(0, [1.0, -2.0], [np.log(0.5).item(), 0.0])], "ix bigint, mean array<double>, log_std array<double>")
    drawn = np.array([r["vec"] for r in vi_fit.posterior_samples(q, 2, 4000, seed=1).collect()])
    assert np.allclose(drawn.mean(axis=0), [1.0, -2.0], atol=0.08) and np.allclose(drawn.std(axis=0), [0.5, 1.0], atol=0.05)


def test_stream_steps_can_be_replayed(spark, model, tmp_path):
    pairs = spark.range(400).select(
        F.pmod("id", F.lit(5)).alias("i"), F.pmod("id", F.lit(7)).alias("j"), (F.col("id") % 2).cast("double").alias("x")
    )
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "fit")
    pairs.repartition(3).write.parquet(feed)
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    partial_fit.partial_fit_stream(model, stream, folder, 400).awaitTermination(120)
    steps = partial_fit.steps(spark, folder)
    assert steps.agg(F.sum("n")).first()[0] == 400
    after = array_of(partial_fit.latest_model(spark, model, folder).theta, "vec")
    assert not np.allclose(after, array_of(model.theta, "vec"))
    # Replaying the last micro-batch starts from the state before it and leaves the step count alone.
    last = steps.orderBy(F.desc("batch")).first()
    partial_fit.partial_fit_batch(model, pairs, last["batch"], folder, 400)
    again = partial_fit.steps(spark, folder).collect()
    assert sorted(r["step"] for r in again) == list(range(1, last["step"] + 1))
    assert len({r["batch"] for r in again}) == len(again)


def files_below(path):
    return sum(len(names) for _, _, names in os.walk(path))


def test_many_micro_batches_leave_few_files(spark, model, tmp_path):
    folder, scratch = str(tmp_path / "stream"), tmp_path / "scratch"
    spark.conf.set(scale.SCRATCH, str(scratch))
    try:
        pairs = spark.range(30).selectExpr("id % 5 AS i", "id % 7 AS j", "double(id % 2) AS x")
        for batch in range(23):
            partial_fit.partial_fit_batch(model, pairs, batch, folder, 1000)
    finally:
        spark.conf.unset(scale.SCRATCH)
    assert files_below(scratch) == 0
    assert len(os.listdir(f"{folder}/state")) == partial_fit.KEPT
    assert sorted(os.listdir(f"{folder}/steps")) == ["level=0-20", "level=0-21", "level=0-22", "level=1-19", "level=1-9"]
    rows = partial_fit.steps(spark, folder).orderBy("batch").collect()
    assert [(r["batch"], r["step"], r["n"]) for r in rows] == [(b, b + 1, 30) for b in range(23)]
    # A replay after its log was merged: the step is taken again and counted once.
    before = array_of(partial_fit.latest_model(spark, model, folder).theta, "vec")
    partial_fit.partial_fit_batch(model, pairs, 22, folder, 1000)
    assert partial_fit.steps(spark, folder).count() == 23
    assert np.allclose(array_of(partial_fit.latest_model(spark, model, folder).theta, "vec"), before)


def test_fits_delete_what_they_store_on_the_way(spark, model, text_corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(kernel, "THETA_BYTES", 0)
    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        counts = []
        for epochs in (1, 3):
            map_fit.map_estimate(model, text_corpus, ws=WS, ns=NS, batch_size=SIZE // 2, epochs=epochs)
            counts.append(len(os.listdir(tmp_path)))
        assert counts[1] == 2 * counts[0]
    finally:
        spark.conf.unset(scale.SCRATCH)


def test_large_batches_are_stored_without_a_shuffle_and_one_epoch_at_a_time(spark, model, text_corpus, tmp_path, monkeypatch):
    def stored(epoch):
        return {b.number: sorted(map(tuple, b.bags.select("bag_id", "targets", "x", "ctx").collect())) for b in epoch}

    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        data = training.Examples(model, text_corpus, None, None, "cbow", WS, NS, 250, 0, None, True)
        want = stored(data.epoch(1))
        assert "_block" in data.stored.columns
        monkeypatch.setattr(training, "SLICE_BYTES", 64)
        data = training.Examples(model, text_corpus, None, None, "cbow", WS, NS, 250, 0, None, True)
        list(data.epoch(0))
        folders, put = [], data.versions.put

        def counted(bags):
            folders.append(data.versions.last or [n for n in os.listdir(tmp_path) if n.startswith("bags-") and n in before])
            return put(bags)

        before = {os.path.basename(data.versions.last)}
        monkeypatch.setattr(data.versions, "put", counted)
        assert stored(data.epoch(1)) == want
        assert "_block" not in data.stored.columns and folders == [[]]
    finally:
        spark.conf.unset(scale.SCRATCH)


def test_batches_take_the_prior_of_their_own_rows(spark, model, text_corpus):
    data = training.Examples(model, text_corpus, None, None, "cbow", WS, NS, 250, 0, None, True)
    assert sorted(b.rows for b in data.epoch(0)) == [90, 250, 250, 250]
    pairs = spark.range(605).select(F.lit(1).alias("i"), F.lit(2).alias("j"), F.lit(1.0).alias("x"), F.when(F.col("id") < 5, 7).otherwise(2).alias("batch_id"))
    data = training.Examples(model, None, pairs, 605, "sgns", WS, NS, 250, 0, None, True)
    assert sorted((b.number, b.rows) for b in data.epoch(0)) == [(2, 600), (7, 5)]


def test_initial_spread_must_name_every_row(spark, model):
    short = model.theta.limit(3).select("ix", F.col("vec").alias("std"))
    with pytest.raises(ValueError, match="every row"):
        vi_fit.init_variational(model, True, short)
