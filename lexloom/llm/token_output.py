"""Packed token matrices by best-fit decreasing with a segment tree over capacities.

Every task tokenizes its own documents, cuts those that are too long without losing an id, and packs
buffers of pieces: in decreasing length, each piece goes to the open row with the least room that still
fits, which a segment tree over the possible rooms finds in a logarithmic number of steps. A buffer is
written as one bundle of binary files in the shared folder:

* ``<name>.ids.npy``     matrix of ids, one sequence per row, padded;
* ``<name>.cu.npy``      cumulative segment lengths, the rows one after another, each from 0;
* ``<name>.rows.npy``    where each row's lengths begin in the previous file;
* ``<name>.resets.npy``  one bit per position, set where positions restart at 0.

Nothing but the index is shuffled. Names are unique to the attempt, and only the index, which Spark
commits, says which bundles count; files of lost attempts are left unreferenced.

Defined cases: a null or empty text is one piece with the end id only; rows with equal keys are written
as rows of their own; an empty table writes no bundle. Extra columns are not carried.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import files, tokens
from lexloom.plans import scale

TOKENS = 2048
BUFFER_TOKENS = 1 << 22  # ids packed together; bounds a task's memory


class Rooms:
    """Open rows by the room they have left, with a search for the least room that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Least room of at least ``need`` and a row that has it; the row is taken out."""
        at = need + self.leaves
        if not self.count[at]:
            # Up to the first ancestor with rows on its right, then down to the leftmost of them.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at <<= 1
                if not self.count[at]:
                    at += 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1


def pack_decreasing(lengths: list[int], most: int) -> tuple[list[int], list[int], int]:
    """Row and offset of every piece, and the number of rows."""
    rooms, rows = Rooms(most), 0
    row_of, offset_of = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        room, row = found or (most, rows)
        rows += found is None
        row_of[i], offset_of[i] = row, most - room
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return row_of, offset_of, rows


def _npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def write_bundle(uri: str, parts: list[np.ndarray], row_of, offset_of, rows: int, most: int, pad: int) -> list[int]:
    """Write one bundle; returns every piece's number among the segments of its row."""
    ids = np.full((rows, most), pad, parts[0].dtype)
    resets = np.zeros((rows, most), bool)
    segments: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    for i, part in enumerate(parts):
        r, o = row_of[i], offset_of[i]
        ids[r, o : o + len(part)] = part
        resets[r, o] = True
        segments[r].append((o, i))
    place, ends, first = [0] * len(parts), [], [0]
    for row in segments:
        row.sort()
        ends.append(0)
        for n, (o, i) in enumerate(row):
            place[i] = n
            ends.append(o + len(parts[i]))
        first.append(len(ends))
    files.write_bytes(f"{uri}.ids.npy", [_npy(ids)])
    files.write_bytes(f"{uri}.cu.npy", [_npy(np.array(ends, "<i4"))])
    files.write_bytes(f"{uri}.rows.npy", [_npy(np.array(first, "<i8"))])
    files.write_bytes(f"{uri}.resets.npy", [_npy(np.packbits(resets, axis=1))])
    return place


def read_bundle(uri: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The matrix of ids, each row's cumulative lengths, and each position's place in its segment (0 in padding)."""
    ids, ends, first, bits = (
        np.load(io.BytesIO(files.read_range(f"{uri}.{kind}.npy")), allow_pickle=False) for kind in ("ids", "cu", "rows", "resets")
    )
    cu = [ends[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    starts = np.unpackbits(bits, axis=1, count=ids.shape[1]).astype(bool)
    at = np.arange(ids.shape[1])
    positions = at - np.maximum.accumulate(np.where(starts, at, 0), axis=1)
    for row, c in enumerate(cu):
        positions[row, c[-1] :] = 0
    return ids, cu, positions


def write_packed(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    path: str | None = None,
    most: int = TOKENS,
    end: int = 0,
    pad: int = 0,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Write the bundles under ``folder``; returns the stored index, one row per piece.

    ``<key>, piece, start, length, bundle, sequence, segment``: the piece is that segment of that row of the bundle.
    """
    path = path or tokens.default_path()
    source = docs.select(F.col(key), F.col("text"))
    schema = T.StructType(
        [source.schema.fields[0]]
        + T.StructType.fromDDL("piece int, start bigint, length bigint, bundle string, sequence int, segment int").fields
    )
    kind = source.schema.fields[0].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        parts: list[np.ndarray] = []
        about: list[tuple] = []

        def flush() -> pa.RecordBatch:
            row_of, offset_of, rows = pack_decreasing([len(p) for p in parts], most)
            uri = f"{folder}/pack-{uuid.uuid4().hex}"
            place = write_bundle(uri, parts, row_of, offset_of, rows, most, pad)
            columns = [
                pa.array([a[0] for a in about], to_arrow_type(kind)),
                pa.array([a[1] for a in about], pa.int32()),
                pa.array([a[2] for a in about], pa.int64()),
                pa.array([len(p) for p in parts], pa.int64()),
                pa.array([uri] * len(parts), pa.string()),
                pa.array(row_of, pa.int32()),
                pa.array(place, pa.int32()),
            ]
            parts.clear(), about.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        held = 0
        for batch in batches:
            keys = batch.column(key).to_pylist()
            for name, ids in zip(keys, tokens.document_ids(batch, path, "text", end), strict=True):
                for n, s in enumerate(range(0, len(ids), most)):
                    parts.append(ids[s : s + most])
                    about.append((name, n, s))
                    held += len(parts[-1])
                    if held >= buffer_tokens:
                        yield flush()
                        held = 0
        if parts:
            yield flush()

    return scale.materialise(source.mapInArrow(write, schema), "packed-index")


def read_packed(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read every indexed piece back from its bundle: the index with ``offset`` and ``ids_crc32``."""
    fields = {f.name: f for f in index.schema.fields}
    schema = T.StructType(
        [fields[key], fields["piece"], fields["start"]]
        + T.StructType.fromDDL("length bigint, ids_crc32 bigint, bundle string, sequence int, offset bigint").fields
    )

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        ids, cu, positions = read_bundle(rows["bundle"].iloc[0])
        start, length, crc = [], [], []
        for sequence, segment in zip(rows["sequence"], rows["segment"], strict=True):
            a, b = cu[sequence][segment : segment + 2]
            if not np.array_equal(positions[sequence, a:b], np.arange(b - a)):
                raise ValueError("positions do not restart with the segment")
            start.append(int(a)), length.append(int(b - a)), crc.append(tokens.crc32(ids[sequence, a:b]))
        return rows[[key, "piece", "start"]].assign(
            length=length, ids_crc32=crc, bundle=rows["bundle"], sequence=rows["sequence"], offset=start
        )

    return index.groupBy("bundle").applyInPandas(read, schema)
