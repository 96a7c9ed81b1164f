"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about a megabyte; a bundle is a file of frames
that ends in the seek table of the seekable format (a skippable frame with each frame's compressed and
decompressed size). The index maps a record to its bundle, its frame and the offset within the
decompressed frame, so that one record costs one ranged read and one frame.

Pages with equal payloads of at least ``revisit_bytes`` bytes are written once: the one with the
largest page_id is the response, the others are revisits that refer to it and carry its digest and length. Equality
is SHA-1, length and a second 64-bit hash together.

Every task writes its own bundles under names unique to the attempt; the index, which Spark commits, says
which bundles count. Nothing but the index and, where copies exist, the pages on their digest is shuffled.

Defined cases: null html is an empty payload; a null url has no target URI; a row with a null page_id has no
page id in its record and is never the response of a group that has ids; rows that repeat the response's
page_id are responses too; an empty table writes no bundle. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import files
from lexloom.plans import scale

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
REVISIT_BYTES = 1000
LEVEL = 3
# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no date, and equal input shall give equal archives

INDEX = "page_id bigint, record_id string, bundle string, frame int, offset bigint, length bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _page_urn(page_id: int) -> str:
    return f"<urn:lexloom:page:{page_id}>"


def _page_of(urn: str | None) -> int | None:
    return int(urn[:-1].rsplit(":", 1)[1]) if urn and urn.startswith("<urn:lexloom:page:") else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Identifier and bytes of one record; a revisit if ``refers_to`` is given."""
    name = _page_urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of every record of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = _headers(frame[at:end])
        size = int(head["content-length"])
        yield at, head, frame[end + 4 : end + 4 + size]
        at = end + 8 + size


def describe(head: dict[str, str], block: bytes) -> tuple:
    """A record as a row of ``RECORD``: digest and length of the payload itself, of a revisit as it states them."""
    http, _, payload = block.partition(b"\r\n\r\n")
    url = head.get("warc-target-uri")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    page = _page_of(head["warc-record-id"])
    if head["warc-type"] == "response":
        return page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, url
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    return page, int(_headers(http)["content-length"]), stated, "revisit", _page_of(head["warc-refers-to"]), url


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEK_TABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def frame_places(uri: str) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of every frame, from the seek table at the end of a bundle."""
    size = files.file_size(uri)
    n, _, magic = struct.unpack("<IBI", files.read_range(uri, size - 9, 9))
    if magic != SEEK_TABLE_MAGIC:
        raise ValueError(f"{uri} has no seek table")
    entries, places, start = files.read_range(uri, size - 9 - 8 * n, 8 * n), [], 0
    for packed, unpacked in struct.iter_unpack("<II", entries):
        places.append((start, packed, unpacked))
        start += packed
    return places


def responses(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, refers_to``: which page a page revisits, null for responses."""
    page = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    same = {"sha": F.sha1("payload"), "bytes": F.octet_length("payload"), "second": F.xxhash64("payload")}
    marked = page.withColumns(same)
    repeated = (
        page.where(F.octet_length("payload") >= revisit_bytes)
        .select("page_id", *[c.alias(k) for k, c in same.items()])
        .groupBy(*same)
        .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND keep IS NOT NULL")
        .drop("n")
    )
    # Stored, so that both sides of the join are plain shuffles and a payload with very many copies is split.
    repeated = scale.materialise(repeated, "repeated-payloads")
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("keep")), None).otherwise(F.col("keep"))
    return marked.join(repeated, list(same), "left").select("page_id", "url", "payload", refers_to.alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    revisit_bytes: int = REVISIT_BYTES,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write bundles under ``folder``; returns the stored index (``INDEX``), one row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)

        def records():
            for batch in batches:
                for columns in zip(*batch.columns, strict=True):
                    yield record(*[c.as_py() for c in columns])

        stream = records()
        following = next(stream, None)
        while following is not None:
            uri = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
            frames: list[tuple[int, int]] = []
            index: list[tuple] = []

            def packed(uri=uri, frames=frames, index=index):
                nonlocal following
                written = 0
                while following is not None and written < bundle_bytes:
                    parts, size = [], 0
                    # A frame holds at least one record, however large.
                    while following is not None and (not parts or size + len(following[1]) <= frame_bytes):
                        name, data = following
                        index.append((_page_of(name), name, uri, len(frames), size, len(data)))
                        parts.append(data)
                        size += len(data)
                        following = next(stream, None)
                    data = packer.compress(b"".join(parts))
                    frames.append((len(data), size))
                    written += len(data)
                    yield data
                yield seek_table(frames)

            files.write_bytes(uri, packed())
            columns = list(zip(*index, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(INDEX)
            )

    rows = responses(pages, revisit_bytes)
    return scale.materialise(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles (``RECORD``), read frame by frame through the seek tables."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch["bundle"]:
                for start, packed, unpacked in frame_places(uri):
                    frame = unpacker.decompress(files.read_range(uri, start, packed), max_output_size=unpacked)
                    yield _rows([describe(head, block) for _, head, block in parse(frame)])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = index.select("bundle").distinct().repartition(parts, "bundle")
    return bundles.mapInPandas(read, RECORD)


def read_records(index: DataFrame, pages: DataFrame) -> DataFrame:
    """The records of some ``page_id``s by random access: one ranged read for each frame they lie in."""
    wanted = index.join(pages.select("page_id").distinct(), "page_id", "left_semi")

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        uri, number = rows["bundle"].iloc[0], int(rows["frame"].iloc[0])
        start, packed, unpacked = frame_places(uri)[number]
        frame = zstandard.ZstdDecompressor().decompress(files.read_range(uri, start, packed), max_output_size=unpacked)
        found = [next(parse(frame[o : o + n])) for o, n in zip(rows["offset"], rows["length"], strict=True)]
        return _rows([describe(head, block) for _, head, block in found])

    return wanted.groupBy("bundle", "frame").applyInPandas(read, RECORD)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_names(RECORD))
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
