"""Token ids of whole texts inside Spark tasks, by a public tokenizer file given as a path.

A BPE file with word ends and the usual word pattern drops white space and lower-cases, so the ids of a
text are those of its parts (letters, digits, signs) one after another. For such a file each distinct part is encoded
once per worker and looked up afterwards. The parts still to encode are given to the model joined by spaces and
told apart by the word ends. Words with characters beyond printable ASCII and the Latin letters and signs below, words
with the string of a special token, and files of any other layout go through the tokenizer as they are. Results
are the tokenizer's own ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the word pattern of the layout described above.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters whose class, small letter and normal form are the same by every version of Unicode, and the word pattern over them.
LETTERS = "a-zß-öø-ÿœ"
SAFE = "!-~À-ÖØ-öø-ÿŒœ«»¡¿‘’“”–—…"
UNSAFE_TEXT = re.compile(rf"[^ \t-\r{SAFE}]|<\|")
SAFE_PATTERN = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\r{LETTERS}0-9]+")
BLANKS = re.compile(r"[ \t-\r]+")
WORD_END = "</w>"
# Parts a worker remembers; beyond it forgets all and starts again.
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64
SLICE_CHARS = 1 << 20  # characters of texts whose parts are held at a time


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as arrays; ``dtype`` holds any id of the file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        described = json.loads(self.whole.to_str())
        self.by_word = self._drops_space(described)
        if self.by_word:
            rest = described["pre_tokenizer"]["pretokenizers"][1:]
            pre = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}
            described |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": pre}
            self.words_only = Tokenizer.from_str(json.dumps(described))
            self.ends = np.zeros(size + 1, bool)
            for token, i in self.words_only.get_vocab().items():
                self.ends[i] = token.endswith(WORD_END)
            self.known: dict[str, bytes] = {}

    @staticmethod
    def _drops_space(described: dict) -> bool:
        normal = [n["type"] for n in (described.get("normalizer") or {}).get("normalizers", [])]
        first = ((described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        model = described["model"]
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and (first.get("pattern") or {}).get("Regex") == WORD_PATTERN
            and first.get("invert") is True
            and model.get("end_of_word_suffix") == WORD_END
            and not model.get("dropout")
            and all(t["content"].startswith("<|") for t in described["added_tokens"])
        )

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of parts, and of words that are unsafe and so never equal a part."""
        new, odd = [], []
        for part in missing:
            (odd if UNSAFE_TEXT.search(part) else new).append(part)
        found = {}
        if new:
            ids = np.array(self.words_only.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(cuts) != len(new):
                raise ValueError("the model's word ends do not match its words")
            raw, bounds = ids.tobytes(), [0, *cuts.tolist()]
            found.update(zip(new, (raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))
        for word, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            found[word] = np.array(e.ids, self.dtype).tobytes()
        return found

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not UNSAFE_TEXT.search(text):
            return SAFE_PATTERN.findall(text.lower())
        out = []
        for word in BLANKS.split(text):
            if UNSAFE_TEXT.search(word):
                out.append(word)
            else:
                out += SAFE_PATTERN.findall(word.lower())
        return out

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        missing = [p for p in set().union(*parts) if p not in known]
        found = self._learn(missing) if missing else {}
        long = {p: i for p, i in found.items() if len(p) > LONGEST_REMEMBERED}
        known.update(found)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for p in long:
            del known[p]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of every text as bytes of ``dtype``; none for a null text."""
        if not self.by_word:
            for text in texts:
                ids = self.whole.encode_batch_fast([text or ""], add_special_tokens=False)[0].ids
                yield np.array(ids, self.dtype).tobytes()
            return
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > SLICE_CHARS:
                yield from self._encode_parts(held)
                held, size = [], 0
            if len(text) > SLICE_CHARS:
                yield b"".join(raw for piece in _cut(text) for raw in self._encode_parts([piece]))
            else:
                held.append(text)
                size += len(text)
        yield from self._encode_parts(held)


def _cut(text: str) -> Iterator[str]:
    """A long text in slices that end at an ASCII blank, across which no token of the layout reaches."""
    at = 0
    while at < len(text):
        blank = BLANKS.search(text, min(at + SLICE_CHARS, len(text)))
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = blank.end() if blank else end


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; kept for later tasks of the same Python worker."""
    kept = sys.modules.setdefault("_lexloom_worker", types.ModuleType("_lexloom_worker"))
    found = kept.__dict__.get(path)
    if found is None:
        found = kept.__dict__[path] = Encoder(path)
    return found


def document_ids(batch: pa.RecordBatch, path: str, text: str, end: int) -> Iterator[np.ndarray]:
    """Ids of every text of a batch, each followed by the id ``end``."""
    made = encoder(path)
    tail = np.array([end], made.dtype).tobytes()
    # In slices, so that the words of few texts are held at a time.
    for at in range(0, batch.num_rows, 64):
        for raw in made.encode(batch.column(text).slice(at, 64).to_pylist()):
            yield np.frombuffer(raw + tail, made.dtype)


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, most: int = 2048, end: int = 0
) -> DataFrame:
    """One row per piece: ``row, <key>, piece, start, length, ids_crc32``.

    A document's ids end with ``end``; only a document of more than ``most`` ids is cut, into pieces of that
    length. ``row`` tells rows apart that share a key; it is fixed once the result is stored.
    """
    path = path or default_path()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias(key), F.col(text).alias("text"))
    schema = T.StructType(
        [*source.schema.fields[:2], *T.StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint").fields]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(document_ids(batch, path, "text", end)):
                for n, s in enumerate(range(0, len(ids), most)):
                    part = ids[s : s + most]
                    at.append(i), piece.append(n), start.append(s), length.append(len(part)), crc.append(crc32(part))
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(place),
                    batch.column(key).take(place),
                    pa.array(piece, pa.int32()),
                    *[pa.array(v, pa.int64()) for v in (start, length, crc)],
                ],
                names=["row", key, "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(cut, schema)
