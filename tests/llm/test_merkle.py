import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_leaf(r, more=0):
    return h(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))


def brute_tree(nodes, fanout):
    """Levels from the leaves to the root."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def brute_steps(levels, rank, fanout):
    for level in levels[:-1]:
        run = rank - rank % fanout
        yield rank % fanout, [level[i] for i in range(run, min(run + fanout, len(level))) if i != rank]
        rank //= fanout


def brute(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        leaf = brute_leaf(r)
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf, brute_leaf(r, 1) if hit and r.n_chars is not None else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = brute_tree([x[2] for x in groups[g]], fanout)
    top = brute_tree([trees[g][-1][0] for g in names], fanout)
    root, out = top[-1][0], Counter()
    for k, g in enumerate(names):
        for rank, (known, key, leaf, folded) in enumerate(groups[g]):
            steps = [*brute_steps(trees[g], rank, fanout), *brute_steps(top, k, fanout)]
            for digit, others in steps:
                folded = h(*others[:digit], folded, *others[digit:])
            proof = h(*[o for _, others in steps for o in others])
            out[(key if known else None, leaf, trees[g][-1][0], root, proof, folded, folded == root)] += 1
    return out


def proofs(docs, fanout=2):
    leaves = merkle.document_leaves(docs, merkle.tampered(F.col("doc_id")))
    return merkle.prove(merkle.manifest(leaves, carry=["changed"], fanout=fanout), changed="changed")


@pytest.fixture(scope="module")
def many(spark):
    """Groups of 1, 2, 5, 64, 65 and 500 leaves, with equal rows and keys."""
    rows = [(i, f"text {i}", g, "s", i) for g, n in ((None, 1), ("", 2), ("b", 64), ("ä", 65), ("z", 500), ("Z", 5)) for i in range(n)]
    rows += [(7, "text 7", "z", "s", 7)] * 70 + [(7, "other", "z", None, None)] * 3
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)


@pytest.mark.parametrize("fanout", [2, 3, 10])
def test_proofs_over_several_tiers(many, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "BLOCK", 4)  # blocks of 4, 3 and 10 leaves
    got = proofs(many, fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(many.collect(), fanout)
    assert Counter(map(tuple, got.collect())) == want
    assert {k[-1] for k in want} == {True, False}


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = odd_docs.drop("kept", "label")
    assert Counter(map(tuple, proofs(docs).collect())) == brute(docs.collect())
    assert proofs(no_docs).count() == 0
    one = odd_docs.where("doc_id = 4")
    assert Counter(map(tuple, proofs(one).collect())) == brute(one.collect())


def test_proofs_of_some_keys(many, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    made = merkle.manifest(merkle.document_leaves(many))
    some = merkle.prove(made, many.where("doc_id IN (3, 64)").select("doc_id"))
    every = Counter((r.doc_id, r.leaf, r.proof_sha256) for r in merkle.prove(made).collect() if r.doc_id in (3, 64))
    assert Counter((r.doc_id, r.leaf, r.proof_sha256) for r in some.collect()) == every and some.where("NOT verified").isEmpty()


def test_equal_blocks_are_one_record(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = spark.createDataFrame([(1, "g", h("x"))] * 64, "doc_id bigint, lang string, leaf string")
    made = merkle.manifest(rows)
    assert made.records.count() == 3  # 16 equal blocks of 4 leaves, 4 equal blocks of them, and their root
    got = merkle.prove(made).collect()
    assert len(got) == 64 and all(r.verified for r in got) and len({r.proof_sha256 for r in got}) == 1
