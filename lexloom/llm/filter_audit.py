"""Filter interaction audit: what every order of a set of filters removes, from one pass over the documents.

A document's failures are a mask with one bit per filter. Every mask is mapped to one wide integer: a field of 64
bits for each outcome at each step of each order (five filters: 120 orders of 5 steps, 600 step outcomes) that holds 0 or 1.
Adding the integers of documents adds all their outcomes at once, and as no part has 2^64 documents, no field
carries into the next one. Tasks add up the integers of their own rows per part, sums of tasks are added in two levels,
so that a part with a third of all rows is never one group, and only the final sum of a part is unpacked.

Texts are read once; the rows passed on hold the key, the part, the mask and a 128-bit BLAKE2 digest of the text,
by which identical texts are told. Digests that occur twice or more and labels are joined to those narrow rows, hot ones salted.

Defined cases: a null text counts as empty, a null part as ``''``. A null key comes after all others: its text
is a repeat if any row with a key has it, and it has no labels. Rows with equal keys are documents of their own, neither
of them smaller. A key with several labels is good or toxic if one of them says so. An empty table
gives an empty result. Extra columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.plans import scale

# Filter letters by bit: few words, few distinct words, many capitals, symbols, text of an earlier document.
FILTERS = "ABCDE"
FEW_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")

FIELD_BYTES = 8
OUTCOMES = ("kept", "removed", "redundant")
PARTS_HELD = 1024  # parts a task adds up before it passes its sums on
TASK_GROUPS = 256  # groups in which the sums of a part's tasks meet before they meet as one


def text_failures(text: str | None) -> tuple[int, bytes]:
    """Mask of the filters that need the text alone, and the digest of the text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes: cut at ASCII space only
    mask = len(words) < FEW_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text or "")) << 2
    mask |= (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    return int(mask), hashlib.blake2b(raw, digest_size=16).digest()


def failures(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``<key>, part, mask`` of every document, with all filters; stored."""
    source = docs.select(F.col(key).alias(key), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    schema = T.StructType([*source.schema.fields[:2], *T.StructType.fromDDL("mask int, high bigint, low bigint").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_failures(t.as_py()) for t in batch.column("text")]
            digests = np.frombuffer(b"".join(d for _, d in found), ">i8").reshape(-1, 2).astype(np.int64)
            columns = [pa.array([m for m, _ in found], pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=schema.fieldNames())

    rows = scale.materialise(source.mapInArrow(read, schema), "failures")
    texts = rows.groupBy("high", "low").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    twice = scale.materialise(texts.where("_n > 1 AND _first IS NOT NULL").drop("_n"), "repeated-texts")
    joined = scale.lookup_join(rows, twice, ["high", "low"], how="left")
    later = F.col("_first").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("_first")))
    return joined.select(key, "part", F.col("mask").bitwiseOR(F.when(later, REPEATED).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``good`` and ``toxic`` (0 or 1) to stored rows."""
    flags = [F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    flagged = scale.materialise(labels.where(F.col(key).isNotNull()).groupBy(key).agg(*flags).where("good = 1 OR toxic = 1"), "flags")
    known = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("good", "toxic")]
    none = [F.lit(0).alias(n) for n in ("good", "toxic")]
    # Rows without a key have no labels; in the join they would all meet in one task.
    named = scale.lookup_join(rows.where(F.col(key).isNotNull()), flagged, [key], how="left").select(*rows.columns, *known)
    return named.unionByName(rows.where(F.col(key).isNull()).select("*", *none))


class Layout:
    """Where the fields of the wide integers are, for these filters and flags."""

    def __init__(self, filters: str, flags: Sequence[str]):
        self.filters, self.flags = filters, tuple(flags)
        self.orders = ["".join(p) for p in permutations(filters)]
        self.columns = [*OUTCOMES, *(f"{f}_lost" for f in self.flags)]
        self.shape = (len(self.orders), len(filters), len(self.columns))
        self.bytes = FIELD_BYTES * (int(np.prod(self.shape)) + len(filters))

    def wide(self, code: int) -> int:
        """The integer of one document; ``code`` is its mask, with a bit for each flag above it."""
        n = len(self.filters)
        mask, flags = code & ((1 << n) - 1), code >> n
        steps = np.zeros(self.shape, "<u8")
        for o, order in enumerate(self.orders):
            gone = False
            for s, letter in enumerate(order):
                fails = bool(mask >> self.filters.index(letter) & 1)
                steps[o, s, 0] = not (gone or fails)
                steps[o, s, 1] = fails and not gone
                steps[o, s, 2] = fails and gone
                for f in range(len(self.flags)):
                    steps[o, s, 3 + f] = fails and not gone and flags >> f & 1
                gone |= fails
        alone = np.array([mask == 1 << i for i in range(n)], "<u8")
        return int.from_bytes(steps.tobytes() + alone.tobytes(), "little")

    def unpack(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts by order, step and outcome, and the documents that fail one filter only."""
        fields = np.frombuffer(total.to_bytes(self.bytes, "little"), "<u8").astype(np.int64)
        cut = int(np.prod(self.shape))
        return fields[:cut].reshape(self.shape), fields[cut:]


def audit(rows: DataFrame, filters: str = FILTERS, flags: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters and step, from ``part``, ``mask`` and the flags (0 or 1) of documents.

    Counts: ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter, removed before),
    ``unique_fails`` (fails its filter only), ``<flag>_lost`` (removed by it, with the flag), and ``shapley`` (removed
    by its filter over all orders).
    """
    layout = Layout(filters, flags)
    code = F.col("mask").cast("int")
    for i, flag in enumerate(flags):
        code = code + F.col(flag).cast("int") * (1 << (len(filters) + i))
    coded = rows.select("part", code.alias("code"))

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % TASK_GROUPS
        wide: dict[int, int] = {}
        sums: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            made = [pa.array(list(sums)), pa.array([salt] * len(sums), pa.int32()), pa.array([v.to_bytes(layout.bytes, "little") for v in sums.values()], pa.binary())]
            sums.clear()
            return pa.RecordBatch.from_arrays(made, names=["part", "salt", "packed"])

        for batch in batches:
            met = pa.Table.from_batches([batch]).group_by(["part", "code"]).aggregate([([], "count_all")])
            for part, code, n in zip(*(met.column(c).to_pylist() for c in ("part", "code", "count_all")), strict=True):
                if code not in wide:
                    wide[code] = layout.wide(code)
                sums[part] = sums.get(part, 0) + n * wide[code]
                if len(sums) >= PARTS_HELD:
                    yield flush()
        if sums:
            yield flush()

    def total(group: pa.Table) -> int:
        return sum(int.from_bytes(v.as_py(), "little") for v in group.column("packed"))

    def add_tasks(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part").slice(0, 1), "packed": pa.array([total(group).to_bytes(layout.bytes, "little")], pa.binary())})

    letters = np.array([[filters.index(c) for c in order] for order in layout.orders])
    names = [*layout.columns, "unique_fails", "shapley"]

    def unpack(group: pa.Table) -> pa.Table:
        steps, alone = layout.unpack(total(group))
        removed = steps[:, :, OUTCOMES.index("removed")]
        shapley = np.array([removed[letters == i].sum() for i in range(len(filters))])
        made = {"part": pa.array([group.column("part")[0].as_py()] * letters.size, pa.string())}
        made["filter_order"] = pa.array(np.repeat(layout.orders, len(filters)).tolist(), pa.string())
        made["step"] = pa.array(np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(layout.orders)))
        values = [*(steps[:, :, k] for k in range(len(layout.columns))), alone[letters], shapley[letters]]
        return pa.table(made | {n: pa.array(v.ravel().astype(np.int64)) for n, v in zip(names, values, strict=True)})

    sums = coded.mapInArrow(add_rows, "part string, salt int, packed binary")
    halfway = sums.groupBy("part", "salt").applyInArrow(add_tasks, "part string, packed binary")
    return halfway.groupBy("part").applyInArrow(unpack, "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in names))


def interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """The audit of the five filters over whole documents, with what their labels call good or toxic."""
    rows = scale.materialise(failures(docs, key, part, text), "masks")
    return audit(with_labels(rows, labels, key))
