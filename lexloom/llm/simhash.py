"""SimHash near-duplicates found with vantage-point trees.

A text's fingerprint has the majority bits of the 64-bit hashes of its word shingles. Distinct fingerprints are
split into shards by a vantage-point tree over Hamming distance, fitted on a bounded sample: each node
has a vantage fingerprint and a radius, and a fingerprint goes to the inside or the outside. By the
triangle inequality a fingerprint can only have partners in a shard if its distance to every vantage on
the way leaves room for ``radius`` bits, so it is sent to its own shard and, as a query, to the shards
behind it in number whose boundary it comes near. Each shard builds a tree of its own over its members and
searches it for all pairs; the sample decides only how even the shards are, never what is found.

A shard passes on a spanning forest, one edge per fingerprint at most, and not the pairs. Components are joined by
minimum labels with pointer jumping, stored after each round. A copy costs nothing beyond its own
fingerprint, because trees and links only see distinct ones.

Defined cases: null, empty and blank texts have fingerprint zero, which is linked like any other; fewer words
than a shingle make one shingle; equal rows share a component; an empty table gives an empty result.
Extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import free_name, numbered
from lexloom.plans import scale

SHINGLE = 3
SEED = 42
RADIUS = 3
SAMPLE = 16384  # distinct fingerprints that fit the tree of shards
SHARD_ROWS = 32768  # members of a shard the tree aims at
LEAF = 64
SLICE = 1 << 15  # shingles or queries handled at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A to Z only, cut at ASCII space only
    if not words:
        return 0
    total, bits = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, total, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), np.uint8)
        bits += np.add.reduce(np.unpackbits(hashes).reshape(-1, 64), axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``fingerprint`` of every row, stored."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.fieldNames())

    return scale.materialise(source.mapInArrow(hashed, schema), "fingerprints")


def _distance(a: np.ndarray, b) -> np.ndarray:
    # As unsigned numbers: of a signed one, numpy counts the bits of its absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16)


class Tree:
    """A vantage-point tree; every leaf holds places in ``points``."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf, self.leaves = points, leaf, []
        self.root = self._build(np.arange(len(points)), 1)

    def _build(self, places: np.ndarray, depth: int):
        if len(places) > self.leaf and depth < 64:
            # The farthest point from the first one: vantages at the rim spread the distances.
            vantage = self.points[places[np.argmax(_distance(self.points[places], self.points[places[0]]))]]
            d = _distance(self.points[places], vantage)
            radius = int(np.median(d))
            if (d <= radius).all():
                radius = int(d.max()) - 1
            if (d <= radius).any():
                return (vantage, radius, self._build(places[d <= radius], depth + 1), self._build(places[d > radius], depth + 1))
        self.leaves.append(places)
        return len(self.leaves) - 1

    def reach(self, queries: np.ndarray, margin: int) -> Iterator[tuple[int, np.ndarray]]:
        """Every leaf with the places of the queries that come within ``margin`` of its region."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, who = stack.pop()
            if not len(who):
                continue
            if isinstance(node, int):
                yield node, who
                continue
            vantage, radius, inside, outside = node
            d = _distance(queries[who], vantage)
            stack.append((inside, who[d - margin <= radius]))
            stack.append((outside, who[d + margin > radius]))


class Sets:
    """Disjoint sets over places; a set is named by its least member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return int(i)

    def flat(self) -> np.ndarray:
        while True:
            up = self.of[self.of]
            if np.array_equal(up, self.of):
                return up
            self.of = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.stack([self.of[a], self.of[b]], axis=1)
        for x, y in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0):
            x, y = self.root(x), self.root(y)
            self.of[max(x, y)] = min(x, y)


def linked(members: np.ndarray, visitors: np.ndarray, radius: int) -> np.ndarray:
    """For members, then visitors: the least place each is linked to through members within ``radius``."""
    points = np.concatenate([members, visitors])
    tree, sets = Tree(members, LEAF), Sets(len(points))
    for at in range(0, len(points), SLICE):
        for leaf, who in tree.reach(points[at : at + SLICE], radius):
            places = tree.leaves[leaf]
            q, p = np.nonzero(_distance(points[who + at][:, None], members[places][None, :]) <= radius)
            if len(q):
                sets.join(who[q] + at, places[p])
                sets.flat()
    return sets.flat()


def links(nodes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A spanning forest per shard of the pairs of distinct fingerprints within ``radius``: ``a, b`` with a <> b."""
    total = nodes.count()
    drawn = nodes.select("fingerprint").orderBy(F.xxhash64("fingerprint")).limit(sample).toPandas()
    shards = max(1, -(-total // shard_rows))
    tree = Tree(drawn["fingerprint"].to_numpy(np.int64), max(8, -(-len(drawn) // shards)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fingerprint").to_numpy()
            home = np.empty(len(points), np.int64)
            for leaf, who in tree.reach(points, 0):
                home[who] = leaf
            for leaf, who in tree.reach(points, radius):
                who = who[home[who] <= leaf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), leaf, np.int32)), pa.array(points[who]), pa.array(home[who] == leaf)],
                    names=["shard", "fingerprint", "member"],
                )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        member = rows["member"].to_numpy(bool)
        values = rows["fingerprint"].to_numpy(np.int64)
        points = np.concatenate([values[member], values[~member]])
        if not member.any():
            return pd.DataFrame({"a": points[:0], "b": points[:0]})
        root = linked(values[member], values[~member], radius)
        edges = root != np.arange(len(points))
        return pd.DataFrame({"a": points[edges], "b": points[root[edges]]})

    dealt = nodes.select("fingerprint").mapInArrow(deal, "shard int, fingerprint bigint, member boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of the stored edges ``a, b``; the label is the least node reachable."""
    both = scale.materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = scale.materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = closer.join(jump, "label").select("node", "was", F.least("label", "further").alias("label"))
        moved = scale.materialise(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return labels


def near_copies(docs: DataFrame, key: str = "doc_id", keep: list[str] | None = None, text: str = "text", **options) -> DataFrame:
    """``keep``, the key, ``fingerprint``, ``label`` (one per component) and ``component_id``, its smallest key."""
    marks = fingerprints(docs, list(dict.fromkeys([*(keep or []), key])), text)
    nodes = scale.materialise(marks.groupBy("fingerprint").agg(F.min(key).alias("low")), "distinct-fingerprints")
    found = components(scale.materialise(links(nodes, **options), "links"))
    named = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("label", F.coalesce("label", "fingerprint"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    # Stored, so that a fingerprint with very many rows meets a plain shuffle and can be split.
    named = scale.materialise(named.join(lowest, "label").select("fingerprint", "label", "component_id"), "components")
    return marks.join(named, "fingerprint")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every component: that with the smallest key (null comes last), of equal keys the first as stored; columns as given."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = near_copies(rows, key, [row], text, **options)
    first = found.groupBy("label").agg(
        F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r"))).alias("first")
    )
    return rows.join(first.select(F.col("first.r").alias(row)), row, "left_semi").drop(row)
