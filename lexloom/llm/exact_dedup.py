"""Exact deduplication by composable polynomial fingerprints.

A text, lower-cased in A to Z, is a polynomial over its bytes, evaluated modulo three primes. The value of
a concatenation is the left value shifted by the right length plus the right value, so chunks are hashed
on their own and the shifted values are added in any order. Texts up to ``whole_bytes`` are hashed where
they are read; larger ones are cut into pieces, spread over the cluster and combined by sums.

Texts with equal fingerprints and lengths are then compared: their chunks are aggregated per fingerprint
and chunk number to the least and the greatest chunk, which differ exactly if two texts differ there.
Fingerprints that fail are told apart by the SHA-256 of the text. Groups are sums and maxima, which Spark
combines before the shuffle, so thousands of copies cost no more than other rows.

Defined cases: a null text counts as empty, and empty texts are copies of each other; of equal texts the
row with the largest key stays (a null key is smallest; of rows with equal keys one stays); an empty table
gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import free_name, numbered
from lexloom.plans import scale

CHUNK = 1 << 16  # bytes hashed or compared at a time
WHOLE_BYTES = 8 << 20  # texts above it are hashed in pieces by several tasks
# Three primes below 2**31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 357239131)
MARKS = ["f0", "f1", "f2", "n_bytes"]


class Polynomial:
    """Fingerprints of byte strings; a fingerprint is one value per prime."""

    def __init__(self, primes=PRIMES, bases=BASES):
        self.primes, self.bases = primes, [b % p for b, p in zip(bases, primes, strict=True)]
        self.powers = np.empty((len(primes), CHUNK), np.uint64)
        for row, (p, b) in enumerate(zip(self.primes, self.bases, strict=True)):
            value = 1
            for k in range(CHUNK):
                self.powers[row, CHUNK - 1 - k] = value
                value = value * b % p

    def chunk(self, data: np.ndarray) -> list[int]:
        """Value of at most ``CHUNK`` bytes. Sums stay below 2**63, as a byte plus one is at most 2**8."""
        digits = data.astype(np.uint64) + np.uint64(1)
        powers = self.powers[:, CHUNK - len(data) :]
        return [int(np.dot(w, digits)) % p for w, p in zip(powers, self.primes, strict=True)]

    def shift(self, value: list[int], n_bytes: int) -> list[int]:
        """The value's contribution when ``n_bytes`` follow it."""
        return [v * pow(b, n_bytes, p) % p for v, b, p in zip(value, self.bases, self.primes, strict=True)]

    def text(self, data: bytes) -> list[int]:
        view, total = np.frombuffer(data, np.uint8), [0] * len(self.primes)
        for at in range(0, len(view), CHUNK):
            part = self.chunk(view[at : at + CHUNK])
            after = len(view) - at - len(view[at : at + CHUNK])
            total = [(t + s) % p for t, s, p in zip(total, self.shift(part, after), self.primes, strict=True)]
        return total


def _normal(value: str | None) -> bytes:
    return (value or "").encode().lower()  # bytes.lower changes A to Z only


def fingerprints(rows: DataFrame, row: str, key: str, text: str, whole_bytes: int, primes, bases) -> DataFrame:
    """``_row, key, n_bytes, text_sha256, f0, f1, f2`` of numbered rows, stored."""
    source = rows.select(F.col(row).alias("_row"), F.col(key).alias("key"), F.col(text).alias("text"))
    fields = "n_bytes bigint, text_sha256 string, f0 bigint, f1 bigint, f2 bigint, piece bigint, raw binary"
    schema = T.StructType([*source.schema.fields[:2], *T.StructType.fromDDL(fields).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Polynomial(primes, bases)
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch.column("text")):
                data = _normal(value.as_py())
                digest = hashlib.sha256(data).hexdigest()
                if len(data) <= whole_bytes:
                    at.append(i), out.append((len(data), digest, *hashed.text(data), None, None))
                    continue
                for s in range(0, len(data), whole_bytes):
                    at.append(i), out.append((len(data), digest, None, None, None, s, data[s : s + whole_bytes]))
            place = pa.array(at, pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(place), batch.column("key").take(place)]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=schema.fieldNames(),
            )

    first = scale.materialise(source.mapInArrow(read, schema), "fingerprints")
    plain = ["_row", "key", "n_bytes", "text_sha256", "f0", "f1", "f2"]
    cut = first.where("raw IS NOT NULL")
    if cut.isEmpty():
        return first.select(*plain)

    @F.pandas_udf("f0 bigint, f1 bigint, f2 bigint")
    def shifted(raw, piece, n_bytes):
        import pandas as pd

        hashed = Polynomial(primes, bases)
        values = [
            hashed.shift(hashed.text(r), int(n) - int(s) - len(r)) for r, s, n in zip(raw, piece, n_bytes, strict=True)
        ]
        return pd.DataFrame(values, columns=["f0", "f1", "f2"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut.repartition(parts, "_row", "piece").select(
        "_row", "key", "n_bytes", "text_sha256", shifted("raw", "piece", "n_bytes").alias("f")
    )
    sums = [
        (F.sum(F.col(f"f.f{i}").cast("decimal(38,0)")) % F.lit(p)).cast("bigint").alias(f"f{i}") for i, p in enumerate(primes)
    ]
    combined = spread.groupBy("_row", "key", "n_bytes", "text_sha256").agg(*sums)
    return scale.materialise(first.where("raw IS NULL").select(*plain).unionByName(combined), "fingerprints")


def _differing(rows: DataFrame, row: str, marks: DataFrame, text: str) -> DataFrame:
    """Fingerprints shared by texts that are not equal, found by comparing the texts chunk by chunk."""
    shared = marks.groupBy(*MARKS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    suspects = marks.join(shared, MARKS).select("_row", *MARKS)
    texts = rows.select(F.col(row).alias("_row"), F.col(text).alias("text")).join(suspects, "_row").drop("_row")
    schema = T.StructType.fromDDL("f0 bigint, f1 bigint, f2 bigint, n_bytes bigint, chunk bigint, bytes binary")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, data = [], [], []
            for i, value in enumerate(batch.column("text")):
                text = _normal(value.as_py())
                for n, s in enumerate(range(0, len(text), CHUNK)):
                    at.append(i), number.append(n), data.append(text[s : s + CHUNK])
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(m).take(place) for m in MARKS] + [pa.array(number, pa.int64()), pa.array(data, pa.binary())],
                names=schema.fieldNames(),
            )

    ranges = texts.mapInArrow(chunks, schema).groupBy(*MARKS, "chunk").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    return ranges.where("a <> b").select(*MARKS).distinct()


def copies(
    docs: DataFrame,
    row: str,
    key: str = "doc_id",
    text: str = "text",
    whole_bytes: int = WHOLE_BYTES,
    primes=PRIMES,
    bases=BASES,
) -> DataFrame:
    """One row per row of ``docs``, which are stored with a number ``row``.

    ``_row, <key>, keep_id, group_size, kept, text_sha256``; ``_row`` is that number.
    """
    marks = fingerprints(docs, row, key, text, whole_bytes, primes, bases)
    unequal = scale.materialise(_differing(docs, row, marks, text), "unequal")
    # Equal fingerprints of unequal texts are next to impossible; their groups are split by the digest.
    marks = marks.join(unequal.withColumn("unequal", F.lit(True)), MARKS, "left").withColumn(
        "split", F.when(F.col("unequal"), F.col("text_sha256")).otherwise("")
    )
    group = [*MARKS, "split"]
    sizes = marks.groupBy(*group).agg(
        F.max(F.struct("key", "_row")).alias("keep"), F.count(F.lit(1)).cast("bigint").alias("group_size")
    )
    return marks.join(sizes, group).select(
        "_row",
        F.col("key").alias(key),
        F.col("keep.key").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("keep._row")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those of which an equal one stays; columns as given."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    kept = copies(rows, row, key, text).where("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
