"""Repeated substrings removed by merging Burrows-Wheeler transforms.

Every byte covered by a ``MATCH``-byte string that also starts elsewhere is removed. The work is done on the
parts of texts that can repeat at all, in these steps:

1. *Anchors.* A window of ``MATCH`` bytes is named by the least hash of the ``GRAM``-byte strings in it. Equal
   windows have equal names, and neighbouring windows mostly share theirs, so a text becomes runs of windows, about one
   for every 70 bytes. Names are counted over all texts. Long texts are read in slices, whose windows do not overlap.
2. *Pieces.* Runs whose name occurs again (or that repeat within themselves) become pieces of text. A long run (a text
   with a short period) is cut into pieces of ``RUN_WINDOWS`` windows under the same name, so equal windows still meet.
   Equal pieces are collapsed and counted; all of a piece that occurs twice is repeated.
3. *Transforms.* Distinct pieces are dealt to buckets by name, so equal windows meet in one bucket. A bucket is cut into
   shards, and each shard gets its Burrows-Wheeler transform on its own. Texts are read as words of ``STRIDE``
   bytes at every phase, so a transform's symbol stands for ``STRIDE`` bytes.
4. *Merge.* The transforms of a bucket are merged by refining their interleave: starting from one shard after the
   other, each round reads the preceding symbols in the present order and sorts the interleave stably by them, which
   orders all suffixes by one more word. Suffixes are never compared or sorted again. The round in which two neighbours
   part is their common prefix, and an interval with a common prefix of ``MATCH`` bytes is a repeated string.
5. *Removal.* Covered ranges go back to all places of their piece and are cut out of the texts.

A name with more than ``most_pieces`` distinct pieces, or more than ``most_bytes`` of them (the edge of a passage in very many texts,
or many lines with one beginning), would make a bucket too large; its windows are compared by 128-bit hashes in a grouped count
instead, which any number of tasks can share.
Windows, words and pieces are compared by hashes of 64 bits and more within equal names.

Defined cases: null and empty texts have no bytes; a very long text takes memory for its own bytes and one slice; texts shorter than ``MATCH`` stay whole; repeated rows
lose all that is ``MATCH`` bytes or longer; null keys are kept; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.plans import scale

MATCH = 200
GRAM = 64
STRIDE = 40  # divides MATCH
SLICE = 1 << 18  # bytes of text whose anchors are found at a time
RUN_WINDOWS = 1 << 14  # windows in a piece; divides SLICE, so that pieces of a periodic text begin at few phases
SHARD_BYTES = 1 << 16
BUCKET_BYTES = 1 << 18  # small enough for a processor's cache
MOST_PIECES = 1 << 15
MOST_BYTES = 1 << 22  # a transform takes some 130 bytes for each
FILTER_BITS = (1 << 16, 1 << 28)  # least and greatest size of the filter of repeated names: 32 MB at most
SOME_ROWS = 2000  # texts that are held as lists at a time, and
SOME_BYTES = 1 << 22  # most bytes of them, but for a longer text alone
_BASE = 0x2B5AD4C7F3A1D96B | 1


# --- rolling hashes and anchors --------------------------------------------------------------


def rolling(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A mixed 64-bit hash of every ``width`` bytes, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, have = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if width & have:
            if out is None:
                out, done = power, have
            else:
                # The part found so far comes first, the next power of two after it.
                n = len(data) - done - have + 1
                out = out[:n] * np.uint64(pow(base, have, 1 << 64)) + power[done : done + n]
                done += have
        if done == width:
            break
        power = power[:-have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
        have *= 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


@dataclass
class Runs:
    """Runs of windows with one name: text number, first and last window start in the text, name, whether it repeats in itself."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    name: np.ndarray
    itself: np.ndarray


def anchors(texts: list[bytes]) -> Iterator[tuple[int, Runs]]:
    """Runs of all texts, some texts or a slice of one text at a time, with the number of the first of them.

    Slices of a text come in order. A run that a slice's end cuts counts twice, which only spares no work.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            view = memoryview(texts[at])
            for start in range(0, len(view) - MATCH + 1, SLICE):
                found = _runs([bytes(view[start : start + SLICE + MATCH - 1])])
                found.first += start
                found.last += start
                yield at, found
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        yield at, _runs(texts[at:end])
        at = end


def cut_runs(runs: Runs, windows: int = RUN_WINDOWS) -> Runs:
    """The same windows in runs of at most that many."""
    parts = (runs.last - runs.first) // windows + 1
    if not len(parts) or parts.max() == 1:
        return runs
    of = np.repeat(np.arange(len(parts)), parts)
    first = runs.first[of] + windows * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    return Runs(runs.text[of], first, np.minimum(first + windows - 1, runs.last[of]), runs.name[of], runs.itself[of])


def _runs(texts: list[bytes]) -> Runs:
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < MATCH:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, np.zeros(0, bool))
    grams = rolling(data, GRAM)
    name = _least(grams, MATCH - GRAM + 1)
    change = np.empty(len(name), bool)
    change[0] = True
    np.not_equal(name[1:], name[:-1], out=change[1:])
    change[begin[(begin < len(name)) & (lengths > 0)]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(name)) - 1
    text = np.searchsorted(begin, first, "right") - 1
    # Windows that reach into the next text do not count.
    last = np.minimum(last, begin[text] + lengths[text] - MATCH)
    real = first <= last
    first, last, text = first[real], last[real], text[real]
    # A run that loses its least gram from the left and keeps its name holds that gram twice.
    left = np.flatnonzero(grams[: len(name)] == name)
    run = np.searchsorted(first, left, "right") - 1
    itself = np.zeros(len(first), bool)
    if len(first):
        inside = (run >= 0) & (left < last[run])
        itself[run[inside]] = True
    return Runs(text, first - begin[text], last - begin[text], name[first].view(np.int64), itself)


# --- Burrows-Wheeler transforms --------------------------------------------------------------


def _order(major: np.ndarray, minor: np.ndarray | None = None) -> np.ndarray:
    """Stable order by ``major``, then ``minor`` (both dense from 0): packed into one number where it fits."""
    n = len(major)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(n - 1).bit_length())
    low = 0 if minor is None else max(1, int(minor.max()).bit_length())
    if int(major.max()).bit_length() + low + bits <= 63:
        key = major.astype(np.int64)
        if minor is not None:
            key = (key << low) | minor
        key = (key << bits) | np.arange(n)
        key.sort()
        return key & ((1 << bits) - 1)
    return np.argsort(major, kind="stable") if minor is None else np.lexsort((minor, major))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


@dataclass
class Transform:
    """A shard's suffixes in sorted order: the preceding symbol of each (-1 at the start of a string) and where it begins.

    The first ``strings`` suffixes are the empty ones, one per string; they begin nowhere (-1).
    """

    symbols: np.ndarray
    begins: np.ndarray
    strings: int


def transform(words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Transform:
    """The transform of pieces that lie at ``begin`` in a buffer with one word symbol per position.

    A piece is ``STRIDE`` strings, one per phase; each string is its full words. Every string ends in its own end mark,
    so all suffixes differ, and doubling ranks sorts them.
    """
    per = length - STRIDE + 1  # word positions of a piece
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    string = np.repeat(np.arange(len(begin)) * STRIDE, per) + (place - np.repeat(begin, per)) % STRIDE
    strings, rows = len(begin) * STRIDE, len(place)
    row_at = np.full(len(words) + STRIDE, -1, np.int64)
    row_at[place] = strings + np.arange(rows)
    end = np.repeat(begin + per, per)
    following = np.where(place + STRIDE < end, row_at[np.minimum(place + STRIDE, len(row_at) - 1)], string)
    preceding = place - STRIDE >= np.repeat(begin, per)

    following = np.concatenate([np.arange(strings), following])
    symbol = words[place]
    rank = np.concatenate([np.arange(strings), strings + symbol])
    total = strings + rows
    while True:
        order = _order(rank, rank[following])
        a, b = rank[order], rank[following][order]
        fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(total, np.int64)
        rank[order] = fresh
        if fresh[-1] == total - 1:
            break
        following = following[following]

    before = np.full(total, -1, np.int64)
    before[strings:][preceding] = words[place[preceding] - STRIDE]
    # What precedes an empty suffix is the last word of its string.
    final = place + STRIDE >= end
    before[string[final]] = symbol[final]
    begins = np.concatenate([np.full(strings, -1), place])
    return Transform(before[order], begins[order], strings)


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes ordered by their first ``rounds`` words: shard, begin, and words in common with the one before.

    The interleave only names shards; the n-th mention of a shard is its n-th suffix.
    """
    # Ends come first in every round, in the order of their shards.
    ends = np.repeat(np.arange(len(shards)), [s.strings for s in shards])
    mentions = np.concatenate([ends, np.repeat(np.arange(len(shards)), [len(s.symbols) - s.strings for s in shards])])
    symbols = np.concatenate([s.symbols for s in shards])
    offset = np.cumsum([0, *[len(s.symbols) for s in shards]])[:-1]
    total = len(mentions)
    fixed = len(ends)
    # No word read yet: all suffixes are one block, those that are empty too.
    boundary = np.zeros(total, bool)
    boundary[:1] = True
    common = np.full(total, -1, np.int64)
    common[:1] = 0

    def rows(mentions: np.ndarray) -> np.ndarray:
        """Which suffix each mention is, counted through all shards."""
        out = np.empty(total, np.int64)
        for k in range(len(shards)):
            at = np.flatnonzero(mentions == k)
            out[at] = offset[k] + np.arange(len(at))
        return out

    for depth in range(1, rounds + 1):
        before = symbols[rows(mentions)]
        inner = np.flatnonzero(before >= 0)
        symbol = before[inner]
        order = _order(symbol)
        source = inner[order]
        block = np.cumsum(boundary)[source]
        symbol = symbol[order]
        parts = np.ones(len(source), bool)
        parts[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        mentions = np.concatenate([ends, mentions[source]])
        boundary = np.concatenate([np.ones(fixed, bool), parts])
        common[boundary & (common < 0)] = depth - 1
    common[common < 0] = rounds
    found = rows(mentions)
    return mentions, np.concatenate([s.begins for s in shards])[found], common


def repeated_starts(pieces: list[bytes], shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For every piece, the starts of its ``MATCH``-byte windows that occur at another place in the pieces."""
    length = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    words = _dense(rolling(data, STRIDE))
    words = np.concatenate([words, np.zeros(len(data) - len(words), words.dtype)])
    shard = begin // shard_bytes
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(pieces)]
    shards = [transform(words, begin[a:b], length[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    _, begins, common = merge(shards, MATCH // STRIDE)
    # Intervals of suffixes that agree in MATCH bytes; all of them begin a full window, as empty suffixes differ.
    interval = np.cumsum(common < MATCH // STRIDE) - 1
    many = (np.bincount(interval) > 1)[interval] & (begins >= 0)
    starts = np.sort(begins[many])
    owner = np.searchsorted(begin, starts, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [starts[a:b] - begin[i] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that windows at these ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > MATCH)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + MATCH).tolist(), strict=True))


# --- the job ---------------------------------------------------------------------------------

RANGES = "array<struct<a: int, b: int>>"


def some(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows and few bytes of ``column``: Spark's batches are bounded by rows alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, done + SOME_BYTES, "right"))
        to = min(max(to, at + 1), at + SOME_ROWS)
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def repeated_names(docs: DataFrame, text: str) -> DataFrame:
    """Names of more than one run, or of a run that repeats in itself; counted over all texts."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = ([(v or "").encode() for v in part.column(0).to_pylist()] for part in some(batch, text))
            found = [r for texts in parts for _, r in anchors(texts)]
            if not found:
                continue
            name, at = np.unique(np.concatenate([r.name for r in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([1 + r.itself for r in found]), len(name)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["name", "n"])

    counted = docs.select(text).mapInArrow(names, "name bigint, n bigint")
    repeated = counted.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
    return scale.materialise(repeated, "repeated-names")


def name_filter(names: DataFrame) -> np.ndarray:
    """A bit set that has every repeated name; its size follows their number up to a fixed limit.

    It only spares work: a name that passes by chance gives a piece without a partner.
    """
    bits = FILTER_BITS[0]
    wanted = 32 * names.count()
    while bits < min(wanted, FILTER_BITS[1]):
        bits *= 2
    place = F.col("name").bitwiseAND(F.lit(bits - 1))
    words = (
        names.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(name & 63L AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return out


def _passes(name: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = name & (len(words) * 64 - 1)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def marked(docs: DataFrame, key: str, text: str, names: np.ndarray) -> DataFrame:
    """``row, key, n_bytes``; either the text's bytes and its runs that may repeat, or the digest if there are none."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(names)
    fields = "n_bytes bigint, sha256 string, raw binary, runs array<struct<name: bigint, first: int, last: int>>"
    schema = T.StructType([*source.schema.fields[:2], *T.StructType.fromDDL(fields).fields])
    run_type = pa.struct([("name", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in (part for b in batches for part in some(b, "text")):
            texts = [(v or "").encode() for v in batch.column("text").to_pylist()]
            runs: list[list | None] = [None] * len(texts)
            for at, r in ((at, cut_runs(r)) for at, r in anchors(texts)):
                likely = _passes(r.name, names)
                owner = r.text[likely] + at
                values = list(zip(r.name[likely].tolist(), r.first[likely].tolist(), r.last[likely].tolist(), strict=True))
                bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=len(texts))).tolist()
                for a, b in zip(bounds, bounds[1:], strict=False):
                    found = [dict(zip(("name", "first", "last"), v, strict=True)) for v in values[a:b]]
                    runs[owner[a]] = (runs[owner[a]] or []) + found
            digest = [None if r else hashlib.sha256(t).hexdigest() for t, r in zip(texts, runs, strict=True)]
            raw = [t if r else None for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(raw, pa.binary()),
                    pa.array(runs, pa.list_(run_type)),
                ],
                names=schema.fieldNames(),
            )

    return scale.materialise(source.mapInArrow(mark, schema), "marked")


def _by_merge(pieces: DataFrame, bucket_bytes: int, shard_bytes: int) -> DataFrame:
    """``name, digest, ranges`` of the distinct pieces of names with few of them."""
    size = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-int(size) // bucket_bytes))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        # A name's only piece has no partner, unless it repeats within itself, which its length shows.
        alone = ~rows["name"].duplicated(keep=False) & (rows["bytes"].map(len) == MATCH)
        rows = rows[~alone]
        if not len(rows):
            return pd.DataFrame({"name": [], "digest": [], "ranges": []})
        found = [covered(s) for s in repeated_starts(rows["bytes"].tolist(), shard_bytes)]
        out = rows[["name", "digest"]].assign(ranges=[[{"a": a, "b": b} for a, b in r] for r in found])
        return out[[bool(r) for r in found]]

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandas(search, f"name bigint, digest bigint, ranges {RANGES}")


def _by_count(pieces: DataFrame) -> DataFrame:
    """The same for names with very many distinct pieces or bytes: windows are counted by two hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, data in zip(*batch.columns, strict=True):
                view = np.frombuffer(data.as_py(), np.uint8)
                one, two = rolling(view, MATCH), rolling(view, MATCH, 0x5851F42D4C957F2D)
                n = len(one)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, name.as_py())),
                        pa.array(np.full(n, digest.as_py())),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                    ],
                    names=["name", "digest", "start", "one", "two"],
                )

    fields = "name bigint, digest bigint, start int, one bigint, two bigint"
    found = scale.materialise(pieces.select("name", "digest", "bytes").mapInArrow(windows, fields), "windows")
    twice = found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = scale.materialise(twice, "repeated-windows")
    # A piece has at most RUN_WINDOWS starts.
    starts = found.join(twice, ["one", "two"]).groupBy("name", "digest").agg(F.collect_list("start").alias("starts"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
        for batch in batches:
            ranges = [[{"a": a, "b": b} for a, b in covered(np.sort(np.array(s)))] for s in batch.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ranges, pa.list_(pair))], names=["name", "digest", "ranges"])

    return starts.mapInArrow(united, f"name bigint, digest bigint, ranges {RANGES}")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    shard_bytes: int = SHARD_BYTES,
    most_pieces: int = MOST_PIECES,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """``<key>, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` of every row.

    ``spans`` are the removed byte ranges and ``kept`` the bytes left, both null where nothing is removed.
    """
    stored = marked(docs, key, text, name_filter(repeated_names(docs, text)))
    runs = stored.where("raw IS NOT NULL").select("row", "raw", F.explode("runs").alias("run"))
    data = F.substring(F.col("raw"), F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + MATCH)
    places = runs.select("row", "run.name", "run.first", data.alias("bytes")).withColumn("digest", F.xxhash64("bytes"))
    pieces = places.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    pieces = scale.materialise(pieces, "pieces")

    per_name = pieces.groupBy("name").agg(F.count(F.lit(1)).alias("of_name"), F.sum(F.octet_length("bytes")).alias("in_name"))
    busy = scale.materialise(per_name.where((F.col("of_name") > most_pieces) | (F.col("in_name") > most_bytes)).select("name"), "busy-names")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.octet_length("bytes").alias("b")))
    twice = pieces.where("n > 1").select("name", "digest", whole.alias("ranges"))
    found = _by_merge(pieces.join(busy, "name", "left_anti").select("name", "digest", "bytes"), bucket_bytes, shard_bytes)
    if not busy.isEmpty():
        found = found.unionByName(_by_count(pieces.join(busy, "name", "left_semi")))
    once = pieces.where("n = 1").select("name", "digest")
    ranges = scale.materialise(twice.unionByName(found.join(once, ["name", "digest"])), "ranges")
    where = places.select("row", "name", "first", "digest").join(ranges, ["name", "digest"])
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    cuts = where.select("row", shifted.alias("cuts")).groupBy("row").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    touched = stored.where("raw IS NOT NULL").select("row", "key", "n_bytes", "raw").join(cuts, "row", "left")
    return _cut_out(touched, stored.where("raw IS NULL").select("key", "n_bytes", "sha256")).withColumnRenamed("key", key)


def _cut_out(touched: DataFrame, others: DataFrame) -> DataFrame:
    source = touched.select("key", "n_bytes", "raw", "cuts")
    tail = f"n_removed bigint, n_spans bigint, kept_sha256 string, spans {RANGES}, kept binary"
    schema = T.StructType([*source.schema.fields[:2], *T.StructType.fromDDL(tail).fields])
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in some(b, "raw")):
            out = []
            for raw, cuts in zip(batch.column("raw").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((c["a"], c["b"]) for c in cuts or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                gone = [{"a": a, "b": b} for a, b in spans]
                out.append((len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), gone or None, kept if spans else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pair), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.fieldNames()
            )

    zero = F.lit(0).cast("bigint")
    untouched = others.select(
        "key",
        "n_bytes",
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.col("sha256").alias("kept_sha256"),
        F.lit(None).cast(RANGES).alias("spans"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return source.mapInArrow(cut, schema).unionByName(untouched)
