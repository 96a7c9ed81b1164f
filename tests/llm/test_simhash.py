import random
from collections import Counter

import numpy as np
import xxhash

from lexloom.llm import simhash as s


def brute_mark(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(keys, marks, radius=3):
    label = list(range(len(marks)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for i, k in enumerate(keys):
        low[root(i)] = min([x for x in (low.get(root(i)), k) if x is not None], default=None)
    return [low[root(i)] for i in range(len(marks))]


def test_marks_of_odd_texts(odd_docs):
    for r in odd_docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)").collect():
        assert s.fingerprint(r.text) & (2**64 - 1) == brute_mark(r.text)
    assert s.fingerprint("a b c d " * 20000) & (2**64 - 1) == brute_mark("a b c d " * 20000)


def test_components_over_many_shards_are_exact(spark):
    rng = random.Random(4)
    marks = [rng.getrandbits(64) for _ in range(400)] + [0]
    for m in list(marks[:60]):
        for _ in range(rng.randint(1, 12)):  # chains of near fingerprints around some of them
            for k in rng.sample(range(64), rng.randint(0, 3)):
                m ^= 1 << k
            marks.append(m)
    nodes = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in set(marks)], "fingerprint bigint")
    edges = s.scale.materialise(s.links(nodes, sample=200, shard_rows=40), "links")
    label = {r.node: r.label for r in s.components(edges).collect()}
    names = [int(np.uint64(m).view(np.int64)) for m in set(marks)]
    want = brute_components(names, list(set(marks)))
    got = [label.get(n, n) for n in names]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert edges.groupBy("a").count().where("count > 40").count() == 0


def test_whole_query_on_near_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(30)]
    for t in texts[:10]:
        for _ in range(6):
            words = t.split()
            words[rng.randrange(300)] = "new"
            texts.append(" ".join(words))
    texts += ["", None, "  ", texts[0].upper(), "two words"]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_copies(df).collect()}
    marks = [brute_mark(t) for t in texts]
    keys = [100 - i for i in range(len(texts))]
    want = brute_components(keys, marks)
    assert got == {k: (int(np.uint64(m).view(np.int64)), c) for k, m, c in zip(keys, marks, want, strict=True)}
    assert len(set(want)) < len(texts) - 20


def test_stage_keeps_one_row_of_each_component(odd_docs, no_docs):
    got = s.without_near_copies(odd_docs)
    assert got.columns == odd_docs.columns
    rows = odd_docs.collect()
    want = brute_components([None if r.doc_id is None else r.doc_id for r in rows], [brute_mark(r.text) for r in rows])
    texts = Counter(brute_mark(r.text) for r in got.collect())
    assert max(texts.values()) == 1 and got.count() == len(set(want))
    assert s.near_copies(no_docs).count() == 0 and s.without_near_copies(no_docs).count() == 0
