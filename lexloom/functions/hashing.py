"""Reproducible randomness.

Every random draw is a hash of (seed, purpose, stable ids), so a result does not
depend on partitioning, task retries or executor loss, and plain SQL can recompute it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# 12 hex digits of an md5 make one 48-bit uniform number.
_HEX_DIGITS = 12
_SCALE = float(2 ** (4 * _HEX_DIGITS))


def _digest(seed: int, purpose: str, ids) -> Column:
    parts = [F.lit(f"{seed}:{purpose}")] + [i.cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def _hex_uniform(digest: Column, start: int) -> Column:
    digits = F.substring(digest, start, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform(seed: int, purpose: str, *ids: Column) -> Column:
    """Uniform number in [0, 1) determined by ``seed``, ``purpose`` and ``ids``."""
    return _hex_uniform(_digest(seed, purpose, ids), 1)


def chance_bar(chance: Column) -> Column:
    """The digest below which a draw is below ``chance``: 12 hex digits, or a letter beyond them if every draw is."""
    steps = F.ceil(chance * F.lit(_SCALE))
    digits = F.lower(F.lpad(F.hex(steps), _HEX_DIGITS, "0"))
    return F.when(steps >= F.lit(int(_SCALE)), F.lit("g")).otherwise(digits)


def happens(bar: Column, seed: int, purpose: str, *ids: Column) -> Column:
    """Whether :func:`uniform` of the same ids is below the chance of ``bar``; the digest is compared as text, no number is made."""
    return _digest(seed, purpose, ids) < bar


def normal(seed: int, purpose: str, *ids: Column) -> Column:
    """Standard normal number (Box-Muller on the two halves of one digest)."""
    digest = _digest(seed, purpose, ids)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _hex_uniform(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _hex_uniform(digest, 1 + _HEX_DIGITS))


def draw_index(n: int, seed: int, purpose: str, *ids: Column) -> Column:
    """Uniform integer in 0..n-1."""
    return F.floor(uniform(seed, purpose, *ids) * F.lit(float(n))).cast("bigint")


# The same draws for numbers that a task already holds as arrays: many short texts are hashed at once, word by word of
# their MD5 blocks. Tests hold these to the expressions above.

_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TOGETHER = 8192  # texts hashed at once, so that the arrays stay in the processor's cache


def _blocks(prefix: bytes, ids: list[np.ndarray | int], n: int, widths: list[int]) -> list[np.ndarray | int]:
    """The 16 words of the block of ``prefix:id:id..``; ids in arrays have as many digits as ``widths`` says.

    A word that is the same in all texts is a number."""
    plain, at = bytearray(prefix), []
    for number, width in zip(ids, widths):
        plain += b":"
        if isinstance(number, np.ndarray):
            at.append((len(plain), number, width))
            plain += bytes(width)
        else:
            plain += str(number).encode()
    length = len(plain)
    if length > 55:
        raise ValueError("a draw's name and numbers have at most 55 characters")
    plain += b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
    words: list = [int.from_bytes(plain[4 * w : 4 * w + 4], "little") for w in range(16)]
    for start, number, width in at:
        rest = number.astype(np.uint64)
        for place in range(start + width - 1, start - 1, -1):
            tens = rest // np.uint64(10)
            digit = (rest - tens * np.uint64(10) + np.uint64(48)).astype(np.uint32)
            words[place // 4] = words[place // 4] + (digit << np.uint32(8 * (place % 4)))
            rest = tens
    return [w if isinstance(w, np.ndarray) else np.uint32(w) for w in words]


def _md5(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first three words of the digests."""
    begin = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v, np.uint32) for v in begin)
    mixed, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind < 2:
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=mixed)
            np.bitwise_and(mixed, x, out=mixed)
            np.bitwise_xor(mixed, z, out=mixed)
        elif kind == 2:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        else:
            np.bitwise_not(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if word.ndim:
            np.add(mixed, word, out=mixed)
            np.add(mixed, np.uint32(_SINES[i]), out=mixed)
        else:
            np.add(mixed, np.uint32((int(word) + _SINES[i]) & 0xFFFFFFFF), out=mixed)
        np.add(mixed, a, out=mixed)
        turn = _TURNS[kind][i % 4]
        np.left_shift(mixed, np.uint32(turn), out=high)
        np.right_shift(mixed, np.uint32(32 - turn), out=mixed)
        np.bitwise_or(mixed, high, out=mixed)
        # The oldest word's array takes the new one.
        np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return a + begin[0], b + begin[1], c + begin[2]


def _numbers(seed: int, purpose: str, ids: tuple, halves: int) -> list[np.ndarray]:
    """The uniform numbers of the digests' first, or first two, runs of 12 hex digits."""
    n = next(len(i) for i in ids if isinstance(i, np.ndarray))
    out = [np.empty(n) for _ in range(halves)]
    prefix = f"{seed}:{purpose}".encode()
    shape = np.zeros(n, np.int64)
    for number in ids:
        if isinstance(number, np.ndarray):
            if n and number.min() < 0:
                raise ValueError("draws in arrays are named by numbers from 0")
            digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), number, side="right") + 1
            shape = shape * 20 + digits
    for code in np.unique(shape):
        rows = np.flatnonzero(shape == code)
        for lo in range(0, len(rows), _TOGETHER):
            at = rows[lo : lo + _TOGETHER]
            some = [i[at] if isinstance(i, np.ndarray) else i for i in ids]
            widths = [len(str(i[0])) if isinstance(i, np.ndarray) else 0 for i in some]
            a, b, c = (w.byteswap().astype(np.uint64) for w in _md5(_blocks(prefix, some, len(at), widths), len(at)))
            out[0][at] = (a << np.uint64(16) | b >> np.uint64(16)).astype(np.float64) / _SCALE
            if halves > 1:
                out[1][at] = ((b & np.uint64(0xFFFF)) << np.uint64(32) | c).astype(np.float64) / _SCALE
    return out


def uniform_array(seed: int, purpose: str, *ids: np.ndarray | int) -> np.ndarray:
    """:func:`uniform` of arrays of whole numbers from 0, and of numbers that are the same for all."""
    return _numbers(seed, purpose, ids, 1)[0]


def normal_array(seed: int, purpose: str, *ids: np.ndarray | int) -> np.ndarray:
    """:func:`normal`, likewise."""
    first, second = _numbers(seed, purpose, ids, 2)
    return np.sqrt(-2.0 * np.log(1.0 - first)) * np.cos(2.0 * math.pi * second)


def draw_index_array(n: int, seed: int, purpose: str, *ids: np.ndarray | int) -> np.ndarray:
    """:func:`draw_index`, likewise."""
    return np.floor(uniform_array(seed, purpose, *ids) * float(n)).astype(np.int64)


def drawn_vectors(dim: int, draw: Callable[[tuple[np.ndarray, ...]], np.ndarray], *ids: Column) -> Column:
    """A list of ``dim`` numbers a row: ``draw`` of the arrays of the ``ids``, each repeated for the elements, and of the elements' places."""

    def drawn(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        numbers = [np.repeat(c.to_numpy().astype(np.int64), dim) for c in columns]
        values = draw(*numbers, np.tile(np.arange(dim), n)) if n else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(values))

    return F.arrow_udf(drawn, "array<double>")(*ids)
