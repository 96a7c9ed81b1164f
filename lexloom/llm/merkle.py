"""Merkle manifest of a dataset as a content-addressed graph, and proofs found by descending it.

Every row is a leaf digest. The leaves of a group (a tree) ascend by key; each run of ``fanout`` consecutive nodes
becomes their digest until one is left, the subroot; the subroots in the order of their groups likewise give the root.
A digest H is the SHA-256 of the inputs one after another, digests as hex text.

A tree is hashed in blocks of at most 1,024 consecutive nodes: a block's nodes meet in one row, all levels inside
it are computed there, and the next tier does the same with the block roots. So a tree of N leaves takes
log(N) / log(1024) shuffles, each over a 1,024th of the rows of the one before, and a group with a third
of all rows is dealt over as many tasks as any other. A block is stored as one record under its root's digest: the
digests of its nodes level by level, which are the children of every digest in it.

A proof is found from the root down: a request takes the record its digest names, follows the digits of its rank in base
``fanout`` to one child after another, collects the children not taken, and goes on with the record of the digest it
arrives at. Requests share a prefix of digits as long as they go the same way and only part inside a block, so a tier
handles one request per block. At the leaves the collected segments are reversed: leaf to root.

Defined cases: a null field is ``-`` in a leaf, so null and empty differ; a null group comes first and a null key comes
first in its group; rows with equal keys are ordered by their leaves, and equal rows are leaves of their own with proofs
of their own; an empty table has no leaves, no proofs and no root. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.plans import scale

FANOUT = 2
BLOCK = 1024  # most leaves of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree over the subroots


def leaf_digest(values: Sequence[Column]) -> Column:
    """H of the values in order, each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def parent(children: Sequence[bytes]) -> bytes:
    """Digest of child digests, both as raw bytes."""
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def climb(nodes: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes and the levels above them, the last one with the root of the block."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([parent(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def split_levels(packed: bytes, width: int, levels: int, fanout: int) -> list[list[bytes]]:
    """The levels of a stored block of ``width`` nodes."""
    out, at = [], 0
    for _ in range(levels + 1):
        out.append([packed[i : i + 32] for i in range(at, at + 32 * width, 32)])
        at, width = at + 32 * width, -(-width // fanout)
    return out


def paths_down(block: list[list[bytes]], fanout: int) -> list[list[bytes]]:
    """For each lowest node of a block, one step per level from its root down: the digit taken and the children not taken."""
    paths: list[list[bytes]] = [[]]
    for level in reversed(block[:-1]):
        below = []
        for i in range(len(level)):
            run, digit = i - i % fanout, i % fanout
            others = level[run:i] + level[i + 1 : run + fanout]
            below.append([*paths[i // fanout], bytes([digit]) + b"".join(others)])
        paths = below
    return paths


def proof_digest(path: Sequence[bytes]) -> bytes:
    """H of the siblings of a path from the root down, read from the leaf up."""
    return sha256(b"".join(step[1:].hex().encode() for step in reversed(path))).digest()


def fold(leaf: bytes, path: Sequence[bytes], known: dict | None = None) -> bytes:
    """The root that follows from a leaf and its path; ``known`` keeps what paths have in common."""
    known = {} if known is None else known
    value = leaf
    for height in range(len(path), 0, -1):
        step = path[height - 1]
        key = (height, value, step)
        found = known.get(key)
        if found is None:
            others = [step[i : i + 32] for i in range(1, len(step), 32)]
            found = known[key] = parent([*others[: step[0]], value, *others[step[0] :]])
        value = found
    return value


@dataclass(frozen=True)
class Manifest:
    """``leaves(tree, n, place, <columns>, leaf)``, ``records(digest, width, levels, nodes)`` and the root (null without rows).

    ``tiers`` are the block roots ``(tree, n, place, digest)`` tier by tier, of which a proof takes only where
    the trees end.
    """

    leaves: DataFrame
    records: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    root: bytes | None
    fanout: int
    levels: int

    @property
    def block(self) -> int:
        return self.fanout**self.levels


def _block_of(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _tier(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes(tree, n, place, digest)`` block by block: ``tree, n, place, digest, width, levels, nodes``; stored."""
    block = fanout**levels
    members = F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "digest")))
    grouped = nodes.groupBy("tree", "n", F.expr(f"place div {block}").alias("block")).agg(members.alias("members"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, digests in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                up = min(levels, depth(n, fanout))
                built = climb(digests, up, fanout)
                made.append((built[-1][0], len(digests), up, b"".join(d for level in built for d in level)))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["tree", "n", "place", "digest", "width", "levels", "nodes"])

    kind = "tree bigint, n bigint, place bigint, digest binary, width int, levels int, nodes binary"
    rows = grouped.select("tree", "n", F.col("block").alias("place"), F.col("members.digest").alias("digests"))
    return scale.materialise(rows.mapInArrow(build, kind), "merkle-blocks")


def _tiers(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """All tiers above the nodes, as long as a tree has more than one block."""
    block, found = fanout**levels, []
    while True:
        tier = _tier(nodes, fanout, levels)
        found.append(tier)
        open_trees = tier.where(F.col("n") > block)
        if open_trees.isEmpty():
            return found
        nodes = open_trees.select("tree", F.expr(f"(n + {block - 1}) div {block}").alias("n"), "place", "digest")


def _records(tiers: list[DataFrame]) -> DataFrame:
    """One record per digest: equal blocks at different places are stored once."""
    kept = [t.select("digest", "width", "levels", "nodes") for t in tiers]
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    return every.dropDuplicates(["digest"])


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", carry: Sequence[str] = (), fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows(<group>, <key>, leaf, <carry>)``, ``leaf`` being a digest as hex text."""
    if not 2 <= fanout <= 255:
        raise ValueError("fanout must be from 2 to 255")
    levels = _block_of(fanout)
    # Nulls first, then by bytes; a name for the group that is never null.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    extra = [F.col(c) for c in dict.fromkeys([key, *carry])]
    # The number parts equal rows, so that they can be dealt over several partitions.
    flat = rows.select(name.alias("_g"), F.col(key).alias("_k"), F.unhex("leaf").alias("leaf"), F.monotonically_increasing_id().alias("_r"), F.struct(*extra).alias("_c"))
    placed = scale.dense_index(scale.materialise(flat, "leaves"), ["_g", "_k", "leaf", "_r"], "_at")
    placed = scale.materialise(placed.select("_at", "_g", "leaf", "_c"), "placed-leaves")
    trees = placed.groupBy("_g").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("n"))
    trees = scale.materialise(scale.dense_index(trees, ["_g"], "tree"), "trees")
    place = (F.col("_at") - F.col("_from")).alias("place")
    leaves = scale.lookup_join(placed, trees, ["_g"]).select("tree", "n", place, "_c.*", "leaf")
    leaves = scale.materialise(leaves, "numbered-leaves")
    tiers = _tiers(leaves.select("tree", "n", "place", F.col("leaf").alias("digest")), fanout, levels)
    block, groups = fanout**levels, trees.count()
    subroots = _ends(tiers, block).select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(groups).cast("bigint").alias("n"), F.col("tree").alias("place"), "digest"
    )
    # One subroot alone is the root, and there is nothing above it to descend.
    top_tiers = _tiers(subroots, fanout, levels) if groups > 1 else []
    last = (top_tiers[-1] if top_tiers else subroots).select("digest").first()
    records = scale.materialise(_records([*tiers, *top_tiers]), "records")
    return Manifest(leaves, records, tiers, top_tiers, bytes(last["digest"]) if last else None, fanout, levels)


def _ends(tiers: list[DataFrame], block: int) -> DataFrame:
    """``tree, digest, tier`` of every tree's root."""
    out = None
    for k, tier in enumerate(tiers):
        done = tier.where(F.col("n") <= block).select("tree", "digest", F.lit(k).alias("tier"))
        out = done if out is None else out.unionByName(done)
    return out


_REQUEST = "tree bigint, place bigint, digest binary, subroot binary, path array<binary>"


def _descend(requests: DataFrame, made: Manifest) -> DataFrame:
    """Requests at the roots of blocks as requests at the lowest nodes of those blocks."""
    fanout, block = made.fanout, made.block

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nodes = split_levels(r["nodes"], r["width"], r["levels"], fanout)
                paths, width = paths_down(nodes, fanout), r["width"]
                columns = [
                    pa.array([r["tree"]] * width, pa.int64()),
                    pa.array(range(r["place"] * block, r["place"] * block + width), pa.int64()),
                    pa.array(nodes[0], pa.binary()),
                    pa.array([r["subroot"]] * width, pa.binary()),
                    pa.array([[*r["path"], *p] for p in paths], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "place", "digest", "subroot", "path"])

    return requests.join(made.records, "digest").select(
        "tree", "place", "subroot", "path", "width", "levels", "nodes"
    ).mapInArrow(step, _REQUEST)


def _at_blocks(made: Manifest) -> DataFrame:
    """One request for each block of leaves, arrived there from the root."""
    spark, block = made.leaves.sparkSession, made.block
    ends = _ends(made.tiers, block)
    if made.top_tiers:
        # Down the tree of subroots; its lowest nodes are the roots of the trees.
        reached = spark.createDataFrame([(TOP, 0, made.root, None, [])], _REQUEST)
        for _ in made.top_tiers:
            reached = _descend(reached, made)
        starts = reached.select(F.col("place").alias("tree"), "digest", "path").join(ends.select("tree", "tier"), "tree")
    else:
        starts = ends.withColumn("path", F.array().cast("array<binary>"))
    starts = scale.materialise(
        starts.select("tree", F.lit(0).cast("bigint").alias("place"), "digest", F.col("digest").alias("subroot"), "path", "tier"), "starts"
    )
    requests = None
    for k in range(len(made.tiers) - 1, -1, -1):
        here = starts.where(F.col("tier") == k).drop("tier")
        requests = here if requests is None else here.unionByName(_descend(requests, made))
    return requests


def prove(made: Manifest, wanted: DataFrame | None = None, changed: str | None = None) -> DataFrame:
    """``<columns>, leaf, subroot, root, proof_sha256, folded_root, verified`` of the wanted leaves, or of all.

    ``wanted`` has some of the leaves' columns, usually the key. ``changed`` names a carried column with the
    digest (hex) of a leaf that was tampered with, or null: the root is folded from that one.
    """
    fanout, block = made.fanout, made.block
    leaves = made.leaves if wanted is None else scale.lookup_join(made.leaves, wanted.distinct(), wanted.columns, how="left_semi")
    own = [c for c in leaves.columns if c not in ("tree", "n", "place")]
    carried = [c for c in own if c not in ("leaf", changed)]
    folded = F.col("leaf") if changed is None else F.coalesce(F.unhex(changed), F.col("leaf"))
    member = F.struct(F.col("place"), "leaf", folded.alias("folded"), F.struct(*carried).alias("row"))
    asked = leaves.groupBy("tree", F.expr(f"place div {block}").alias("place")).agg(F.collect_list(member).alias("members"))
    met = asked.join(_at_blocks(made), ["tree", "place"]).join(made.records, "digest")
    root = made.root

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).drop_columns(["members"]).to_pylist()[0]
                flat = members[i].values
                paths = paths_down(split_levels(r["nodes"], r["width"], r["levels"], fanout), fanout)
                proofs, roots, known = [], [], {}
                for place, leaf in zip(flat.field("place").to_pylist(), flat.field("folded").to_pylist(), strict=True):
                    path = [*r["path"], *paths[place % block]]
                    proofs.append(proof_digest(path))
                    roots.append(fold(leaf, path, known))
                columns = [
                    flat.field("row"),
                    flat.field("leaf"),
                    pa.array([r["subroot"]] * len(flat), pa.binary()),
                    pa.array(proofs, pa.binary()),
                    pa.array(roots, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "leaf", "subroot", "proof", "folded"])

    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in made.leaves.select(*carried).schema.fields)
    found = met.select("members", "subroot", "path", "width", "levels", "nodes").mapInArrow(
        answer, f"row struct<{kinds}>, leaf binary, subroot binary, proof binary, folded binary"
    )

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return found.select(
        "row.*",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(root.hex() if root else None).cast("string").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.lit(bytearray(root or b""))).alias("verified"),
    )


def document_leaves(docs: DataFrame, changed: Column | None = None, counted: str = "n_chars") -> DataFrame:
    """``doc_id, lang, leaf`` of documents, and ``changed``: the leaf with one character more counted, where that holds."""
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_digest(list(fields.values()))
    rows = [F.col("doc_id"), F.col("lang"), leaf.alias("leaf")]
    if changed is not None:
        # Wide enough for one more than any count.
        more = fields | {counted: (F.col(counted).cast("decimal(38, 0)") + 1)}
        rows.append(F.when(changed & F.col(counted).isNotNull(), leaf_digest(list(more.values()))).alias("changed"))
    return docs.select(*rows)


def tampered(key: Column) -> Column:
    """Whether 7 divides the CRC-32 of the key as text."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 0, F.lit(False))
