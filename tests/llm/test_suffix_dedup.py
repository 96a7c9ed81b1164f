import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import suffix_dedup as s


def brute(texts, size=s.MATCH):
    counts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t) + 1)
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                cover[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(t)) if cover[i] and not (i and cover[i - 1]))
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(11)

    def prose(n):
        return "".join(rng.choice("abcdefgh éß") for _ in range(n))

    passage, edge = prose(420), prose(199)
    found = [prose(300) + passage + prose(rng.randint(0, 90)) for _ in range(8)]
    found += [edge + prose(100), edge + prose(120), passage, passage[:150], "", None, "ab" * 600, "xyz " * 40 + prose(400)]
    found += [found[0], found[0][:500] + "#" + found[0][500:], prose(199) + "é", passage[1:] + "q", prose(5000)]
    return found


@pytest.mark.parametrize(
    "options",
    [{}, {"bucket_bytes": 4000, "shard_bytes": 900}, {"most_pieces": 1}, {"most_bytes": 900}],
    ids=["one bucket", "many shards", "counted", "counted by bytes"],
)
def test_removed_bytes_agree_with_brute_force(spark, options):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute([(t or "").encode() for _, t in rows])
    got = {r.doc_id: r for r in s.remove_repeats(df, **options).collect()}
    assert len(got) == len(rows)
    for (i, text), w in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, i
        if r.kept is not None:
            assert hashlib.sha256(r.kept).hexdigest() == w[3] and sum(x.b - x.a for x in r.spans) == w[1]
    assert sum(w[1] for w in want) > 5000


def test_merge_orders_all_suffixes_and_finds_common_prefixes():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(700))
    pieces = list({base[a : a + rng.randint(200, 320)] for a in range(0, 400, 23)}) + [b"abcde" * 60]
    counts = Counter(p[i : i + s.MATCH] for p in pieces for i in range(len(p) - s.MATCH + 1))
    for shard_bytes in (1 << 19, 600):
        got = s.repeated_starts(pieces, shard_bytes)
        for p, starts in zip(pieces, got, strict=True):
            assert list(starts) == [i for i in range(len(p) - s.MATCH + 1) if counts[p[i : i + s.MATCH]] > 1]


def test_runs_of_a_long_text_take_memory_for_one_slice():
    text = b"the same line over and over, with nothing new in it\n" * 600_000  # 31 MB
    tracemalloc.start()
    found = [s.cut_runs(r) for _, r in s.anchors([text])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    first, last = np.concatenate([r.first for r in found]), np.concatenate([r.last for r in found])
    assert first[0] == 0 and last[-1] == len(text) - s.MATCH and (first[1:] == last[:-1] + 1).all()
    assert (last - first).max() < s.RUN_WINDOWS
    # Equal pieces collapse: what is left to be merged does not grow with the text.
    assert sum(map(len, {text[a : b + s.MATCH] for a, b in zip(first, last, strict=True)})) < 2e6


@pytest.mark.parametrize("options", [{}, {"most_bytes": 100_000}], ids=["merged", "counted by bytes"])
def test_long_runs(spark, options):
    rng = random.Random(5)
    stamp = "a line begins with the same words as every other line, more than sixty-four bytes of them: "
    log = "".join(stamp + str(rng.randint(0, 300)) * 9 + "\n" for _ in range(4000))  # one run, hardly periodic
    lines = "x" * 60_000 + "a short period " * 30_000 + log[:900]
    rows = list(enumerate([log, lines, log[5000:5400], "clean " + "".join(rng.choice("abcdef") for _ in range(900))]))
    want = brute([t.encode() for _, t in rows])
    got = s.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))
    assert 0 < want[0][1] < want[0][0] and want[3][1] == 0


def test_a_very_long_text_of_one_line(spark):
    line = "one line, again and again, for thirty million bytes\n"
    df = spark.range(1).selectExpr("id AS doc_id", f"repeat('{line[:-1]}\n', 600000) AS text")
    (r,) = s.remove_repeats(df).collect()
    assert (r.n_bytes, r.n_removed, r.n_spans) == (len(line) * 600_000, len(line) * 600_000, 1)


def test_parts_of_a_batch_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(s, "SOME_BYTES", 1000)
    monkeypatch.setattr(s, "SOME_ROWS", 7)
    texts = ["a" * 400, None, "é" * 400, "b" * 5000, "", *["c"] * 20, "d" * 999]
    for kind, values in ((pa.string(), texts), (pa.binary(), [None if t is None else t.encode() for t in texts])):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(values, kind)], names=["k", "v"]).slice(1)
        parts = list(s.some(batch, "v"))
        assert pa.Table.from_batches(parts).to_pydict() == {"k": [*range(1, len(texts))], "v": values[1:]}
        sizes = [[len((x or "").encode() if isinstance(x, str) else x or b"") for x in p.column("v").to_pylist()] for p in parts]
        assert all(len(x) <= 7 and (sum(x) <= 1000 or len(x) == 1) for x in sizes)
    assert list(s.some(batch.slice(0, 0), "v")) == []


def test_odd_rows(odd_docs, no_docs):
    got = s.remove_repeats(odd_docs).collect()
    rows = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)").collect()
    assert len(got) == odd_docs.count()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True))
    small = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id not in (6, 7))
    assert small == want
    assert {r.n_removed == r.n_bytes for r in got if r.doc_id in (6, 7)} == {True}
    assert s.remove_repeats(no_docs).count() == 0
