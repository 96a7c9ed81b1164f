import hashlib
from collections import Counter

from lexloom.llm import exact_dedup as d
from lexloom.llm.common import numbered


def normal(t):
    return (t or "").encode().lower()


def check(docs, got):
    rows = [(r.doc_id, normal(r.text)) for r in docs.collect()]
    size = Counter(t for _, t in rows)
    keep = {}
    for i, t in rows:
        keep[t] = max([x for x in (keep.get(t), i) if x is not None], default=None)
    want = Counter((i, keep[t], size[t], hashlib.sha256(t).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len(size)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups_of_odd_rows(odd_docs):
    check(odd_docs, d.copies(numbered(odd_docs, "n"), "n").collect())


def test_pieces_combine_to_the_fingerprint_of_the_whole():
    hashed = d.Polynomial()
    data = bytes(range(256)) * 1200
    for cut in (1, 70000, 131072, 200001):
        parts = [data[:cut], data[cut:]]
        sums = [0, 0, 0]
        for part, after in zip(parts, (len(parts[1]), 0), strict=True):
            shifted = hashed.shift(hashed.text(part), after)
            sums = [(a + b) % p for a, b, p in zip(sums, shifted, d.PRIMES, strict=True)]
        assert sums == hashed.text(data)


def test_huge_texts_are_hashed_in_pieces(spark):
    big = "abcdefghij" * 30000
    rows = [(1, big), (2, big.upper()), (3, big[:-1] + "x"), (4, "small"), (5, big + "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, d.copies(numbered(docs, "n"), "n", whole_bytes=70000).collect())


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "ba", "aa", "AB", "cc", "zz", "bb", "ab"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, d.copies(numbered(docs, "n"), "n", primes=(2, 3, 2), bases=(1, 1, 1)).collect())


def test_stage_keeps_columns_and_one_row_per_text(odd_docs, no_docs):
    got = d.without_copies(odd_docs)
    assert got.columns == odd_docs.columns
    assert Counter(normal(r.text) for r in got.collect()) == Counter({normal(r.text) for r in odd_docs.collect()})
    assert d.without_copies(no_docs).count() == 0
