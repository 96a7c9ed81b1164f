from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as pipeline
from lexloom.llm import language_id, tokens
from tests.llm.test_exact_dedup import normal
from tests.llm.test_packing import check_places, reference
from tests.llm.test_simhash import brute_components, brute_mark

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(pipeline.STAGES)

    predicted = {r.doc_id: r for r in language_id.identify(docs).collect()}
    left = {i for i, p in predicted.items() if p.lang_pred != "und" and p.score >= pipeline.LEAST_PROBABILITY}
    last = {}
    for i in sorted(left):
        last[normal(rows[i].text)] = i
    left = sorted(last.values())
    component = brute_components(left, [brute_mark(rows[i].text) for i in left])
    left = sorted(set(component))

    unique = stage["near_duplicates"](spark, stage["exact_dedup"](spark, stage["language_id"](spark, docs, SF), SF), SF)
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == left and len(left) < len(rows)

    mixed = stage["mixing"](spark, unique, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 2
    by_source = defaultdict(int)
    for i in left:
        by_source[rows[i].source] += len((rows[i].text or "").encode().split())
    words = sum(n * len(rows[i].text.encode().split()) for i, n in copies.items())
    assert abs(words - 1.5 * sum(by_source.values())) <= len(by_source) * max(len(rows[i].text.encode().split()) for i in left) / 2

    packed = pipeline.run(spark, SF).collect()
    check_places(packed, ["sequence_id"])
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*reference([rows[i].text])[0], 0])
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(i, k, s, len(ids[s : s + 2048]), tokens.crc32(ids[s : s + 2048]))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_every_stage_takes_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            got = stage(spark, docs, SF)
            assert name == "packing" or got.columns == docs.columns
            got.count()
