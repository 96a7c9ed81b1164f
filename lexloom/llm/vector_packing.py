"""Vector best-fit packing of token pieces into sequences.

A piece needs tokens, one document slot and attention cost (the square of its length); a sequence has a
capacity of each. Pieces are placed in decreasing length; among the open sequences that can take a
piece under every constraint the choice falls on the one whose weighted residual is smallest in norm
after placing, or whose residual has the largest weighted dot product with the piece (``rule``).

Pieces are dealt by hash into groups of about ``group_rows`` rows, which are packed independently: a group
wastes at most part of its last sequences, and no task holds more than one group.

Defined cases: a null or empty text is one piece with the end id only; rows with equal keys are packed as
rows of their own; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import tokens
from lexloom.plans import scale

TOKENS = 2048
GROUP_ROWS = 16384
WEIGHTS = (1.0, 0.02, 0.02)  # tokens, documents, attention cost


def best_fit(lengths: np.ndarray, capacity: Sequence[float], weights: Sequence[float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece.

    Open sequences are rows of one array of residuals; a sequence that cannot take even the shortest
    piece is closed. Pieces that fill a sequence alone never enter the search.
    """
    size, scale_by = len(lengths), 1.0 / np.asarray(capacity, float)
    weight = np.asarray(weights, float)
    need = np.stack([lengths, np.ones(size), lengths.astype(float) ** 2], axis=1)
    if size and (need > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    bins, offsets = np.empty(size, np.int64), np.zeros(size, np.int64)
    smallest = lengths.min() if size else 0
    left = np.empty((1024, 3))
    number = np.empty(1024, np.int64)
    opened = used = 0
    for i in np.argsort(-lengths, kind="stable"):
        v = need[i]
        fits = np.flatnonzero((left[:used] >= v).all(axis=1))
        if len(fits):
            rest = left[fits]
            if rule == "norm":
                after = (rest - v) * scale_by
                pick = fits[np.argmin((after * after) @ weight)]
            else:
                pick = fits[np.argmax((rest * scale_by) @ (v * scale_by * weight))]
            offsets[i] = capacity[0] - left[pick, 0]
            bins[i] = number[pick]
            left[pick] -= v
        else:
            pick = used
            bins[i] = opened
            if used == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            left[pick], number[pick] = capacity - v, opened
            used, opened = used + 1, opened + 1
        if left[pick, 0] < smallest or left[pick, 1] < 1:
            used -= 1
            left[pick], number[pick] = left[used], number[used]
    return bins, offsets


def pack(
    pieces: DataFrame,
    tokens_most: int = TOKENS,
    documents_most: int | None = None,
    cost_most: float | None = None,
    weights: Sequence[float] = WEIGHTS,
    rule: str = "norm",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (with ``row``, ``piece`` and ``length``).

    Without limits of their own the documents and the cost of a sequence are bound by its tokens alone.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is norm or dot, got {rule}")
    capacity = np.array([tokens_most, documents_most or tokens_most, cost_most or float(tokens_most) ** 2], float)
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("bigint"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], kind="stable")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        first = int(rows["_group"].iloc[0]) << 32
        return rows.drop(columns="_group").assign(sequence_id=bins + first, offset=offsets)

    return dealt.groupBy("_group").applyInPandas(place, schema)


def packed_documents(docs: DataFrame, path: str | None = None, most: int = TOKENS, **options) -> DataFrame:
    """Tokenize, cut and pack whole documents; ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Texts are read and tokenized once; only the narrow rows of the pieces are stored and shuffled.
    """
    stored = scale.materialise(tokens.pieces(docs, path=path, most=most), "pieces")
    return pack(stored, tokens_most=most, **options).drop("row")
