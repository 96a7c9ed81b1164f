import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from lexloom.llm import filter_audit as fa


def brute_mask(text, repeated):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        re.search(r"[#$%&*|]", text) is not None,
        repeated,
    ]
    return {c for c, f in zip("ABCDE", fails, strict=True) if f}


def brute(rows, good, toxic):
    """Every order walked through, document by document."""
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    found = defaultdict(Counter)
    for r in rows:
        low = first.get(r.text or "")
        fails = brute_mask(r.text, low is not None and (r.doc_id is None or r.doc_id > low))
        for order in map("".join, permutations("ABCDE")):
            left = True
            for step, c in enumerate(order, 1):
                at = found[(r.source or "", order, step)]
                at["unique_fails"] += fails == {c}
                at["redundant"] += c in fails and not left
                if left and c in fails:
                    left = False
                    at["removed"] += 1
                    at["good_lost"] += r.doc_id in good
                    at["toxic_lost"] += r.doc_id in toxic
                    found[(r.source or "", c)]["shapley"] += 1
                at["kept"] += left
    names = ["kept", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails"]
    return {k: (*(v[n] for n in names), found[(k[0], k[1][k[2] - 1])]["shapley"]) for k, v in list(found.items()) if len(k) == 3}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (7, 1, 1), (10, None, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_audit_agrees_with_brute_force(spark, odd_docs, labels):
    words = " ".join(f"w{i}" for i in range(400))
    extra = [(50, words, "a"), (51, words, "b"), (51, words, "a"), (49, words + " #", "a"), (None, words, ""), (52, "A" * 300, None), (None, "alone", "a")]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, source string"), allowMissingColumns=True)
    got = {(r.part, r.filter_order, r.step): (*r[3:],) for r in fa.interactions(docs, labels).collect()}
    want = brute(docs.collect(), {1, 7}, {2, 7})
    assert len(got) == 600 * len({r.source or "" for r in docs.collect()})
    assert got == want


def test_joins_that_are_not_broadcast_and_sums_passed_on_early(spark, odd_docs, labels, monkeypatch):
    want = Counter(map(tuple, fa.interactions(odd_docs, labels).collect()))
    monkeypatch.setattr(fa.scale, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(fa, "PARTS_HELD", 1)
    assert Counter(map(tuple, fa.interactions(odd_docs, labels).collect())) == want


def test_fields_hold_sums_without_carrying():
    layout = fa.Layout("ABCDE", ["good"])
    many = 2**62  # of the largest count of every field
    total = many * layout.wide(0b100001) + many * layout.wide(0b000000) + 7 * layout.wide(0b11111)
    steps, alone = layout.unpack(total)
    first = layout.orders.index("ABCDE")
    assert steps[first, 0].tolist() == [many, many + 7, 0, many] and alone.tolist() == [many, 0, 0, 0, 0]
    assert steps[first, 1].tolist() == [many, 0, 7, 0]
    assert layout.shape[0] * layout.shape[1] == 600


def test_other_filters_and_empty_tables(spark, no_docs, labels):
    assert fa.interactions(no_docs, labels).count() == 0
    assert fa.interactions(no_docs, labels.limit(0)).count() == 0
    rows = spark.createDataFrame([("p", 0b11), ("p", 0b01), ("p", 0)], "part string, mask int")
    got = {(r.filter_order, r.step): (*r[3:],) for r in fa.audit(rows, "XY", []).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 3)}
