import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.llm import language_id as lang

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = lang.identify(docs, keep=["doc_id", "lang"]).collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    # Calibrated: the mean probability is close to the share that is right.
    assert abs(np.mean([r.score for r in out]) - np.mean([r.lang_pred == r.lang for r in out])) < 0.05


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(SF).limit(200)
    swapped = docs.selectExpr(
        "doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zz' ELSE lang END AS lang"
    )
    one = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(docs).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(swapped).collect()}
    assert one == two


def test_odd_rows(odd_docs, no_docs):
    got = lang.identify(odd_docs, keep=odd_docs.columns).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    kept = lang.accepted(odd_docs, 0.0)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL").count() == 0
    assert lang.identify(no_docs).count() == 0
    unlabelled = odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in lang.identify(unlabelled).collect()} == {"und"}


def test_features_do_not_depend_on_the_other_texts():
    grams = lang.Grams()
    texts = ["One, two", "", "é 1 Ü\nx", "...", "a"]
    (first, features, bounds), = grams.batches(pa.array(texts))
    for i, t in enumerate(texts):
        (_, alone, b), = grams.batches(pa.array([t]))
        assert sorted(features[bounds[i] : bounds[i + 1]]) == sorted(alone[b[0] : b[1]])


def plain_ftrl(rows, classes, epochs):
    """One weight at a time, as the method is written down."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        v = z[i, c]
        if abs(v) <= lang.L1:
            return 0.0
        return -(v - math.copysign(lang.L1, v)) / ((lang.BETA + math.sqrt(n[i, c])) / lang.ALPHA + lang.L2)

    for _ in range(epochs):
        for at, x, label in rows:
            w = {(i, c): weight(i, c) for i in at for c in range(classes)}
            logits = [sum(v * w[i, c] for i, v in zip(at, x, strict=True)) for c in range(classes)]
            total = sum(math.exp(v) for v in logits)
            for c in range(classes):
                for i, v in zip(at, x, strict=True):
                    g = v * (math.exp(logits[c]) / total - (c == label))
                    step = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / lang.ALPHA
                    z[i, c] += g - step * w[i, c]
                    n[i, c] += g * g
    return {k: weight(*k) for k in list(z)}


def test_fit_agrees_with_plain_ftrl():
    rng = np.random.default_rng(4)
    rows = [
        # Feature 50 is too small to pass the penalty.
        (np.append(rng.choice(40, 6, replace=False), [50, lang.FEATURES]), np.append(rng.random(6) * 3, [1e-5, 1.0]), int(rng.integers(3)))
        for _ in range(60)
    ]
    got, want = lang.ftrl(rows, 3, 2), plain_ftrl(rows, 3, 2)
    assert np.count_nonzero(got) == sum(v != 0 for v in want.values()) < len(want)
    for (i, c), v in want.items():
        assert abs(got[i, c] - v) < 1e-9


def plain_grams(text):
    """The n-grams of a text as strings: letters lower-cased, everything else one space, a space at both ends."""
    flat = "".join(c if c.isalpha() else " " for c in text.lower())
    words = " " + " ".join(flat.split()) + " "
    if not flat.split():
        words = " "
    return [words[i : i + k] for k in lang.ORDERS for i in range(len(words) - k + 1)]


def test_scores_agree_with_plain_sums():
    rng = np.random.default_rng(8)
    model = lang.Model(["a", "b", "c"], rng.normal(size=(3, lang.FEATURES + 1)).astype(np.float32), 1.7)
    grams = lang.Grams()
    for text in ["One, two", "é 1 Ü\nx", "many words of one text " * 50]:
        ((_, features, bounds),) = grams.batches(pa.array([text]))
        want = np.zeros(3)
        found = plain_grams(text)
        for g in found:
            value = 0
            for c in g:
                value = (value * 0x110001 + ord(c)) % 2**64
            h = (value + len(g)) * 0x9E3779B97F4A7C15 % 2**64
            want += model.table[:, h >> 48]
        want = want / len(found) + model.table[:, -1]
        assert len(features) == len(found)
        assert np.allclose(model.logits(features, bounds)[0], want)
        e = np.exp(want / 1.7 - (want / 1.7).max())
        assert np.allclose(model.probabilities(features, bounds)[0], e / e.sum())


def test_groups_of_languages_score_all_of_them(spark):
    docs = spark.read.parquet(SF)
    learned = docs.where(~lang.held_out(F.col("doc_id")))
    tree = lang.train(learned, at_once=2)
    labels = [v for g in tree.groups for v in g.labels]
    assert labels == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang) and tree.chooser is not None
    one, many = (
        {r.doc_id: (r.lang, r.lang_pred, r.score) for r in lang.predict(docs, tree, ["doc_id", "lang"], groups_a_pass=k).collect()}
        for k in (8, 1)
    )
    assert one == many and len(one) == docs.count()
    out = [r for i, r in one.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([pred == truth for truth, pred, _ in out]) >= 0.98
    # Probabilities of all languages add up to one.
    grams = lang.Grams()
    ((_, f, b),) = grams.batches(pa.array(["some words of a text"]))
    weigh = tree.chooser.probabilities(f, b)
    assert abs(sum(weigh[0, k] * g.probabilities(f, b).sum() for k, g in enumerate(tree.groups)) - 1) < 1e-9


def test_more_languages_than_one_softmax_holds(spark):
    rng = random.Random(2)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + list("éßøñçåłğžśđħ")
    languages = {f"l{k:03d}": ["".join(rng.choices(letters, k=4)) for _ in range(12)] for k in range(200)}
    rows = [(i * 200 + k, " ".join(rng.choices(w, k=15)), name) for k, (name, w) in enumerate(languages.items()) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = lang.identify(docs, keep=["doc_id", "lang"]).collect()
    assert len(got) == len(rows)
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.9
    assert len({r.lang_pred for r in got}) == 200
