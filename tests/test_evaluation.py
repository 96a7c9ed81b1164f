import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import stats
from lexloom.operators import embedding, neighbours, similarity

DIM = 6


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    langs = ["en", "it", "fr"]
    named = {f"w{i}_{langs[i % 3]}": rng.normal(size=DIM) for i in range(300)}
    # Tied candidates: copies under other names.
    named |= {f"z{i}_it": named[f"w{i}_it"] for i in range(1, 60, 3)}
    return named


@pytest.fixture(scope="module")
def model(spark, vectors):
    rows = []
    for key, vec in vectors.items():
        word, label = key.split("_")
        rows.append((word, label, "w", [float(x) for x in vec]))
        rows.append((word, label, "c", [float(-x) for x in vec]))
    df = spark.createDataFrame(rows, "word string, label string, role string, vec array<double>")
    return embedding.model_from_vectors(df, DIM)


def unit(v):
    return v / np.linalg.norm(v)


def ranked(scores, k):
    return [w for w, _ in sorted(scores.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]]


@pytest.mark.parametrize("limit", [None, 1])
def test_neighbours_match_brute_force(spark, model, vectors, limit):
    asked = [f"w{i}_en" for i in range(0, 60, 3)]
    words = spark.createDataFrame([(w,) for w in [*asked, "unknown", asked[0]]], "key string")
    found = neighbours.nearest_neighbors(model, words, 7, limit=limit)
    got = {}
    for r in found.orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["word"])
    for w in asked:
        scores = {o: unit(v) @ unit(vectors[w]) for o, v in vectors.items() if o not in asked}
        assert got[w] == ranked(scores, 7)
    wide = neighbours.nearest_neighbors(model, words, 7, wide=True, limit=limit)
    assert wide.columns == ["target"] + [f"@{i}" for i in range(1, 8)] and wide.count() == len(asked)


def test_shelves_skip_clusters_and_miss_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    vecs = np.repeat(centres, 100, axis=0) + 0.01 * rng.normal(size=(2000, 8))
    vecs[5:9] = vecs[4]  # ties
    words = np.array([f"w{i}" for i in rng.permutation(2000)], dtype=object)
    shelf = neighbours.Shelf(words, vecs)
    assert sorted(shelf.words) == sorted(words)
    for queries in (vecs[:50] + 0.01, rng.normal(size=(30, 8)), np.zeros((2, 8))):
        best = shelf.search(queries, 6)
        for q, scores, found in zip(queries, best.score, best.word):
            assert list(found) == ranked(dict(zip(words, vecs @ q)), 6) and (np.diff(scores) <= 0).all()
    offered = []
    plain = neighbours.Best.offer
    neighbours.Best.offer = lambda self, rows, scores, words: (offered.append(scores.size), plain(self, rows, scores, words))
    try:
        shelf.search(vecs[:50], 6)
    finally:
        neighbours.Best.offer = plain
    assert sum(offered) < 0.3 * 50 * 2000


def test_shelves_and_lanes_copy_little():
    dim, least = 100, neighbours.SHELF_BYTES // 800
    for candidates, queries, tasks in ((10**7, 10**7, 2000), (10**7, 5000, 2000), (500, 10**6, 8), (0, 9, 8), (10**9, 10**9, 100)):
        shelves, lanes = neighbours.shape(candidates, queries, tasks, dim)
        assert shelves * lanes >= tasks and candidates / shelves <= least + 1
        assert shelves == -(-candidates // least) or candidates * lanes + queries * shelves <= 2.1 * max(1, (candidates * queries * tasks)) ** 0.5 + queries + candidates


def test_more_neighbours_than_words(spark):
    rows = [(w, "", "w", [float(i), 1.0]) for i, w in enumerate("abc")]
    tiny = embedding.model_from_vectors(spark.createDataFrame(rows, "word string, label string, role string, vec array<double>"), 2)
    found = neighbours.nearest_neighbors(tiny, spark.createDataFrame([("a",)], "key string"), 9)
    assert [r["word"] for r in found.orderBy("rank").collect()] == ["b", "c"]


@pytest.mark.parametrize("limit", [None, 1])
def test_analogies_match_brute_force(spark, model, vectors, limit):
    keys = sorted(vectors)
    rows = [(i, keys[i], keys[i + 1], keys[i + 2], keys[i + 3]) for i in range(20)] + [(99, "no", *keys[:3])]
    asked = spark.createDataFrame(rows, "row_id bigint, w1 string, w2 string, w3 string, w4 string")
    got = {r["row_id"]: r for r in neighbours.evaluate_analogy(model, asked, 5, limit=limit).collect()}
    assert set(got) == set(range(20))
    for i, a, b, c, d in rows[:20]:
        aim = unit(vectors[a] - vectors[b] + vectors[c])
        want = ranked({o: v @ aim for o, v in vectors.items()}, 5)
        assert got[i]["guesses"] == want and got[i]["correct"] == (d in want)
    strict = neighbours.evaluate_analogy(model, asked, 5, cosine=True, exclude_inputs=True).collect()
    assert all(len(r["guesses"]) == 5 and not {r["w1"], r["w2"], r["w3"]} & set(r["guesses"]) for r in strict)


@pytest.mark.parametrize("reverse", [False, True])
def test_lexicon_induction_matches_brute_force(spark, model, vectors, reverse):
    pairs = [("w0_en", "w1_it"), ("w3_en", "w5_fr"), ("w3_en", "w4_it"), ("w6_en", "none_it")]
    table = spark.createDataFrame(pairs, "source string, target string")
    found = neighbours.bilingual_lexicon_induction(table, model, (1, 5), reverse=reverse).collect()
    assert len(found) == 3
    for r in found:
        lang = r["target"].split("_")[1]
        scores = {o: unit(v) @ unit(vectors[r["source"]]) for o, v in vectors.items() if o.endswith(lang)}
        want = ranked(scores, 5)
        assert r["guesses"] == want and r["p@5"] == (r["target"] in want) and r["p@1"] == (r["target"] == want[0])
    assert neighbours.bli_skipped_pairs(table, model).first()["target"] == "none_it"


def test_similarity_counts_each_pair_once_and_skips_unknown_words(spark, model, vectors):
    keys = sorted(vectors)
    rows = [("s", keys[i], keys[i + 1], float(i % 4)) for i in range(30)]
    rows += [rows[0], ("s", "unknown", keys[0], 1.0), ("flat", keys[0], keys[1], 2.0), ("flat", keys[2], keys[3], 2.0)]
    rows += [("empty", "x", "y", 1.0), ("pair", keys[0], keys[1], 1.0)]
    pairs = spark.createDataFrame(rows, "dataset string, word1 string, word2 string, similarity double")
    got = {r["dataset"]: r for r in similarity.evaluate_word_similarity(pairs, model).collect()}
    known = [r for r in rows if r[0] == "s" and r[1] in vectors]
    cos = [round(unit(vectors[a]) @ unit(vectors[b]), 9) for _, a, b, _ in known]

    def mean_rank(xs):
        return np.array([sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs])

    want = np.corrcoef(mean_rank(cos), mean_rank([r[3] for r in known]))[0, 1]
    assert got["s"]["n"] == 31 and np.isclose(got["s"]["rho"], want)
    assert got["flat"]["rho"] is None and got["empty"]["n"] == 0 and got["pair"]["rho"] is None
    weighted = similarity.weighted_similarity(similarity.evaluate_word_similarity(pairs, model)).first()[0]
    assert np.isclose(weighted, want)
    missing = similarity.embedding_similarities(pairs, model).where(F.col("cosine").isNull())
    assert missing.count() == 2


@pytest.mark.parametrize("rho,n,p", [(0.5, 10, 0.14111328125), (0.0, 20, 1.0), (1.0, 5, 0.0), (0.5, 2, None)])
def test_p_values(rho, n, p):
    got = stats.student_t_two_sided([rho, 0.1], [n, 7])[0]
    assert math.isnan(got) if p is None else math.isclose(got, p, rel_tol=1e-9)


def test_p_values_of_many_correlations_at_once(spark):
    rho = np.array([np.nan, 0.2, -0.2, 0.999, 1e-9, -1.0, 0.01, 0.9, 0.3])
    n = np.array([9, 2, 50, 4, 10**6, 8, 10**9, 3, 100])
    got = stats.student_t_two_sided(rho, n)
    for p, r, k in zip(got, rho, n):
        if math.isnan(r) or k < 3:
            assert math.isnan(p)
        elif abs(r) == 1:
            assert p == 0
        else:  # the density of the angle is a power of the cosine
            x = np.linspace(0, np.pi / 2, 400_001)
            density = np.sin(x) ** (k - 3.0)
            share = np.interp(math.acos(abs(r)), x, np.r_[0, np.cumsum((density[1:] + density[:-1]) / 2)]) / ((density[1:] + density[:-1]) / 2).sum()
            assert k == 10**9 or math.isclose(p, share, rel_tol=2e-4, abs_tol=1e-12)
    assert 0 <= got[6] < 1e-300 or math.isclose(got[6], math.erfc(0.01 * math.sqrt(10**9) / math.sqrt(2)), rel_tol=1e-2)
    rows = [(0.5, 10), (None, 10), (0.5, 2)]
    found = spark.createDataFrame(rows, "rho double, n bigint").select(stats.rank_p_value("rho", "n").alias("p")).collect()
    assert [r["p"] if r["p"] is None else round(r["p"], 9) for r in found] == [0.141113281, None, None]


def test_similarity_takes_few_jobs(spark, model, vectors):
    keys = sorted(vectors)
    rows = [(f"set{i % 3}", keys[i], keys[i + 1], float(i % 7)) for i in range(100)]
    pairs = spark.createDataFrame(rows, "dataset string, word1 string, word2 string, similarity double")
    context = spark.sparkContext
    context.setJobGroup("similarity", "")
    try:
        assert similarity.evaluate_word_similarity(pairs, model).count() == 3
        jobs = context.statusTracker().getJobIdsForGroup("similarity")
    finally:
        context.setJobGroup("", "")
    assert len(jobs) <= 25

def test_p_value_against_the_integrated_density():
    rho, n = 0.3, 25
    t, df = rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2
    x = np.linspace(-t, t, 200_001)
    density = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
    middle = float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())
    assert math.isclose(stats.student_t_two_sided([rho], [n])[0], 1 - middle, rel_tol=1e-6)
