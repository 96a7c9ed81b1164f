import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import align, embedding, graph, likelihood
from lexloom.plans import scale
from lexloom.sources import models


def vocab_of(spark, *entries):
    return spark.createDataFrame([e if isinstance(e, tuple) else (e, "") for e in entries], "word string, label string")


def as_dict(model, role=None):
    return {r["key"]: np.array(r["vec"]) for r in model.vectors(role).collect()}


def test_shared_and_unshared_contexts(spark):
    vocab = vocab_of(spark, ("dog", "2010"), ("dog", "2011"), ("formic_acid", "2010"))
    shared = {r["key"] for r in embedding.build_keys_shared(vocab).collect()}
    assert shared == {"dog_2010", "dog_2011", "formic_acid_2010", "dog_c", "formic_acid_c"}
    apart = [r["ix"] for r in embedding.build_keys_unshared(vocab).collect()]
    assert sorted(apart) == list(range(6))


def test_same_seed_same_vectors(spark):
    vocab = vocab_of(spark, "moi", "mitä", "joo")
    one, two, other = (as_dict(embedding.new_embedding(vocab, 5, seed=s)) for s in (1, 1, 2))
    assert all((one[k] == two[k]).all() for k in one) and any((one[k] != other[k]).any() for k in one)
    assert max(abs(v).max() for v in one.values()) <= 0.5 / 5


def test_lookup_update_contains(spark):
    model = embedding.new_embedding(vocab_of(spark, "a", "b"), 3)
    asked = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "nope")], "n int, key string")
    assert [r["known"] for r in embedding.contains(model, asked).orderBy("n").collect()] == [True, True, True, False]
    with pytest.raises(ValueError, match="nope"):
        embedding.lookup_vectors(model, asked)
    assert embedding.lookup_vectors(model, asked, strict=False).count() == 3
    new = spark.createDataFrame([("b", [1.0, 2.0, 3.0])], "key string, vec array<double>")
    changed = as_dict(embedding.update_vectors(model, new))
    assert list(changed["b"]) == [1.0, 2.0, 3.0] and (changed["a"] == as_dict(model)["a"]).all()
    with pytest.raises(ValueError, match="once"):
        embedding.update_vectors(model, new.union(new))
    with pytest.raises(ValueError, match="not in"):
        embedding.update_vectors(model, new.withColumn("key", F.lit("zz")))


def test_graph_edges_collapse_and_report(spark, tmp_path):
    vocab = vocab_of(spark, "dog", "dogs", "cat")
    edges = spark.createDataFrame(
        [("dog", "dogs"), ("dogs", "dog"), ("cat", "cat"), ("this", "that")], "key1 string, key2 string"
    )
    model = embedding.new_embedding(vocab, 4, edges=edges, lambda1=3.0)
    assert model.edges.count() == 2
    _, omitted = graph.filter_edges(edges, model.keys)
    assert {r["key"] for r in omitted.collect()} == {"this", "that"}
    v = as_dict(model)
    far = ((v["dog"] - v["dogs"]) ** 2).sum()
    want = -0.5 * (sum((x**2).sum() for x in v.values()) + 3.0 * far) * 0.1
    assert np.isclose(likelihood.laplacian_log_prior(model, 10, 100).first()[0], want)
    path = str(tmp_path / "m")
    models.save_embedding(model, path)
    again = models.load_graph_embedding(spark, path)
    assert again.edges.exceptAll(model.edges).count() == 0 and again.lambda1 == 3.0
    assert all((as_dict(again)[k] == x).all() for k, x in v.items())


def test_graph_without_edges_has_no_penalty(spark):
    edges = spark.createDataFrame([("x", "y")], "key1 string, key2 string")
    model = embedding.new_embedding(vocab_of(spark, "a", "b"), 4, edges=edges)
    plain = likelihood.gaussian_log_prior(model, 1, 1).first()[0]
    assert np.isclose(likelihood.laplacian_log_prior(model, 1, 1).first()[0], plain)


def random_model(spark, n=40, dim=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"w{i}", "", role, [float(x) for x in rng.normal(size=dim)]) for i in range(n) for role in "wc"]
    return embedding.model_from_vectors(
        spark.createDataFrame(rows, "word string, label string, role string, vec array<double>"), dim
    )


def test_alignment_undoes_a_rotation_and_keeps_products(spark):
    model = random_model(spark)
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))[0]
    turned = model.with_theta(scale.materialise(align.rotate(model.theta, rotation)))
    back = as_dict(align.align(model, turned, model.keys.select("key")))
    assert all(np.allclose(back[k], v) for k, v in as_dict(model).items())
    few = model.keys.select("key").limit(1)
    with pytest.warns(UserWarning, match="determine"):
        align.align(model, turned, few)
    with pytest.raises(ValueError, match="both models"):
        align.align(model, turned, few.select(F.lit("zz").alias("key")))


def test_rotation_becomes_triangular(spark):
    model = random_model(spark)
    words = [f"w{i}" for i in range(5)]
    turned, before = as_dict(align.normalize_rotation(model, words)), as_dict(model)
    assert np.allclose(np.tril(np.array([turned[w] for w in words]).T, -1), 0)
    assert np.isclose(turned["w7"] @ turned["w9_c"], before["w7"] @ before["w9_c"])
    with pytest.raises(ValueError):
        align.normalize_rotation(model, words[:3])


def test_transfer(spark):
    old = embedding.new_embedding(vocab_of(spark, ("moi", "time1"), ("mitä", "time1"), ("kuuluu", "time1")), 4, seed=1)
    new = embedding.new_embedding(vocab_of(spark, ("moi", "time2"), ("mitä", "time1"), ("joo", "time2")), 4, seed=2)
    source, target = as_dict(old), as_dict(new)
    exact = as_dict(align.transfer_embeddings(old, new))
    assert (exact["mitä_time1"] == source["mitä_time1"]).all() and (exact["moi_time2"] == target["moi_time2"]).all()
    loose = as_dict(align.transfer_embeddings(old, new, ignore_group=True))
    assert (loose["moi_time2"] == source["moi_time1"]).all() and (loose["joo_c"] == target["joo_c"]).all()
