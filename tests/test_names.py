"""Words whose display names look like those of other rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import align, embedding, graph, windows

VOCAB = [("vitamin", ""), ("vitamin_c", ""), ("milk", ""), ("a_b", ""), ("a", "b"), ("dog", "2010"), ("dog", "2011")]


@pytest.fixture(scope="module")
def model(spark):
    return embedding.new_embedding(spark.createDataFrame(VOCAB, "word string, label string"), 3, seed=2)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_a_name_of_two_rows_is_an_error_and_a_row_is_not(spark, model):
    for name in ("vitamin_c", "a_b"):
        with pytest.raises(ValueError, match="two rows"):
            embedding.lookup_vectors(model, keys(spark, name))
        with pytest.raises(ValueError, match="two rows"):
            embedding.update_vectors(model, keys(spark, name).withColumn("vec", F.array(*[F.lit(0.0)] * 3)))
        with pytest.raises(ValueError, match="two rows"):
            graph.filter_edges(spark.createDataFrame([("milk", name)], "key1 string, key2 string"), model.keys)
    rows = spark.createDataFrame([("vitamin_c", "", "w"), ("vitamin", "", "c"), ("a", "b", "w")], "word string, label string, role string")
    assert embedding.lookup_vectors(model, rows).count() == 3
    assert embedding.contains(model, keys(spark, "vitamin_c", "milk", "zebra")).count() == 3
    new = rows.limit(1).withColumn("vec", F.array(*[F.lit(9.0)] * 3))
    after = {tuple(r[:3]): r["vec"] for r in embedding.update_vectors(model, new).vectors().select("word", "label", "role", "vec").collect()}
    assert after[("vitamin_c", "", "w")] == [9.0] * 3
    assert sum(v == [9.0] * 3 for v in after.values()) == 1


def test_shared_contexts_answer_to_their_labels(spark, model):
    found = embedding.lookup_vectors(model, keys(spark, "dog_c", "dog_2010_c", "dog_2011_c")).collect()
    assert len({r["ix"] for r in found}) == 1 and len(found) == 3
    known = {r["key"]: r["known"] for r in embedding.contains(model, keys(spark, "dog_2010_c", "dog_2012_c")).collect()}
    assert known == {"dog_2010_c": True, "dog_2012_c": False}
    shape = embedding.embedding_shape(model).first()
    assert shape["n_rows"] == 7 + 6 and shape["n_keys"] == len({"vitamin", "vitamin_c", "milk", "a_b", "dog_2010", "dog_2011",
        "vitamin_c_c", "milk_c", "a_b_c", "a_c", "dog_c", "dog_2010_c", "dog_2011_c"})


def test_mean_and_alignment_go_by_row(spark, model):
    same = align.posterior_mean([model, model])
    one, two = ({r["ix"]: r["vec"] for r in m.theta.collect()} for m in (model, same))
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i]) for i in one)


def test_supplied_examples_may_name_words_and_contexts(spark, model):
    ix = {(r["word"], r["label"], r["role"]): r["ix"] for r in model.keys.collect()}
    pairs = spark.createDataFrame([("milk", "dog_2010", 1.0), ("milk", "dog_2011_c", 0.0)], "i string, j string, x double")
    got = {r["x"]: (r["i"], r["j"]) for r in windows.external_examples(pairs, model.keys).collect()}
    milk = ix[("milk", "", "w")]
    assert got == {1.0: (milk, ix[("dog", "2010", "w")]), 0.0: (milk, ix[("dog", "", "c")])}
    wide = spark.createDataFrame(
        [("milk", ["dog_c", "milk_c", "dog_c"], 1.0), ("dog_2010", [], 0.0)], "i string, ctx array<string>, x double"
    )
    got = {r["i"]: r["ctx"] for r in windows.external_examples(wide, model.keys).collect()}
    dog = ix[("dog", "", "c")]
    assert got == {milk: [dog, ix[("milk", "", "c")], dog], ix[("dog", "2010", "w")]: []}
    with pytest.raises(ValueError, match="outside the vocabulary"):
        windows.external_examples(wide.withColumn("ctx", F.array(F.lit("zebra"))), model.keys)


def test_json_round_trip(spark, tmp_path):
    from lexloom.sources import models

    vocab = spark.createDataFrame(VOCAB, "word string, label string")
    edges = spark.createDataFrame([("dog_2010", "dog_2011", 2.0)], "key1 string, key2 string, weight double")
    model = embedding.new_embedding(vocab, 3, edges=edges, lambda1=4.0)
    models.export_json(model, str(tmp_path / "json"))
    back = models.load_json(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.vectors().select(*model.vectors().columns).collect())) == sorted(map(str, model.vectors().collect()))
    assert [tuple(r) for r in back.edges.collect()] == [tuple(r) for r in model.edges.select("src", "dst", "weight").collect()]
    assert (back.dim, back.lambda0, back.lambda1, back.shared) == (model.dim, model.lambda0, model.lambda1, model.shared)
