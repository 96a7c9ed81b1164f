"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of characters are hashed to a
fixed number of features. A document's value of a feature is its share of the document's n-grams times the
inverse document frequency, which is counted over all documents that may be learned from. The weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample (``per_label``
documents of each language, in expectation, drawn by a hash of the key): the sample is dealt to a fixed number
of shards (more where a shard would get over ``EXAMPLES``), each shard fits its own weights, and the weights are averaged.
A part of the sample that is not fitted on sets the temperature by which the probabilities are calibrated.

Every language found is learned. Up to ``at_once`` of them are one softmax. More are dealt to groups of that size (or of the square root
of their number, if that is more), each with a softmax of its own, and one more softmax chooses the group: a language's probability is its group's
times its own in the group. No task and no step on the driver holds more than the weights of one group.

A prediction only sees the text: the value is linear in the n-grams, so a whole text is scored by adding up one
row of a table per n-gram. A pass over the texts scores the languages of ``groups_a_pass`` groups and keeps the best so far.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if there is
nothing to learn from; rows with a null language are never learned from; a null key counts as an empty string
for the draws; an empty table gives an empty result; of equally probable languages the first by code point is taken.
Extra columns are not carried, unless named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import hashing
from lexloom.plans import scale

ORDERS = (2, 3)
FEATURES = 1 << 16
PER_LABEL = 2000
AT_ONCE = 64  # languages of one softmax
GROUPS_A_PASS = 8
SHARDS = 8
EXAMPLES = 4096  # of a shard, in expectation
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01
SCALE = 20.0  # brings shares of n-grams to the size the learning rate expects
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
HOLD_SEED = 2
UNKNOWN = "und"
SLICE_CHARS = 1 << 17  # characters and texts whose n-grams a task holds at a time
SLICE_ROWS = 64


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == HOLD_SEED


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))


def _letters() -> np.ndarray:
    """Which code points are letters."""
    known = np.zeros(0x110000, bool)
    # No letters lie beyond the first four planes.
    known[:0x40000] = np.fromiter((chr(c).isalpha() for c in range(0x40000)), bool, 0x40000)
    return known


def _mixed(values: np.ndarray, order: int) -> np.ndarray:
    """Feature of an n-gram from its polynomial value."""
    h = (values + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)


class Grams:
    """Features of texts, many texts at a time."""

    def __init__(self):
        self.letter = _letters()

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first, features, bounds)``: the features of texts ``first + i`` are ``features[bounds[i]:bounds[i + 1]]``."""
        for at in range(0, len(texts), SLICE_ROWS):
            values, first = texts.slice(at, SLICE_ROWS).to_pylist(), 0
            while first < len(values):
                last, chars = first, 0
                while last < len(values) and (last == first or chars + len(values[last] or "") <= SLICE_CHARS):
                    chars += len(values[last] or "")
                    last += 1
                yield (at + first, *self._features([v or "" for v in values[first:last]]))
                first = last

    def _features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A line break, which lower() never makes, stands between texts; inside them it is a space.
        joined = "\n".join(["", *(t.replace("\n", " ").lower() for t in texts), ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bound = points == 10
        points = np.where(bound | self.letter[points], points, np.uint32(32))
        space = ~self.letter[points]
        # Runs of spaces are one space; a text's boundary is a space on both sides.
        keep = np.ones(len(points), bool)
        keep[1:] = ~(space[1:] & space[:-1]) | bound[1:]
        keep[:-1] &= ~((points[:-1] == 32) & bound[1:])
        points, bound = points[keep].astype(np.uint64), bound[keep]
        edges = np.flatnonzero(bound)
        text_of = np.cumsum(bound) - 1
        found, owner = [], []
        for order in ORDERS:
            n = len(points) - order + 1
            value, inside = np.zeros(n, np.uint64), np.ones(n, bool)
            for k in range(order):
                value = value * np.uint64(0x110001) + np.where(bound[k : k + n], np.uint64(32), points[k : k + n])
                if 0 < k < order - 1:
                    inside &= ~bound[k : k + n]
            # An n-gram belongs to the text it starts in; it may begin or end on the text's boundary.
            inside &= np.arange(n) < edges[-1]
            found.append(_mixed(value[inside], order))
            owner.append(text_of[:n][inside])
        features, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable") if len(texts) > 1 else np.arange(len(owner))
        return features[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # a row per label, features + 1 columns (the last is the bias); idf and scale are in it
    temperature: float = 1.0

    def logits(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        size = np.diff(bounds)
        out = np.zeros((len(size), len(self.labels)))
        some = size > 0
        if some.any():
            starts = bounds[:-1][some]
            for k in range(len(self.labels)):
                out[some, k] = np.add.reduceat(self.table[k, features], starts, dtype=np.float64) / size[some]
        return out + self.table[:, -1]

    def probabilities(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(features, bounds) / self.temperature)


@dataclass
class Tree:
    """A softmax per group of languages, in code point order, and one that chooses the group (None for a single group)."""

    groups: list[Model]
    chooser: Model | None = None


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents per feature and documents with a letter, over the whole table; one count per feature and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, total = Grams(), np.zeros(FEATURES, np.int64), 0
        mark = np.zeros(FEATURES, bool)
        for batch in batches:
            for _, features, bounds in grams.batches(batch.column(0)):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    mark[features[a:b]] = True
                    found = np.flatnonzero(mark)
                    seen[found] += 1
                    mark[found] = False
                total += len(bounds) - 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], names=["feature", "n"]
        )

    sums = docs.where(has_letter(F.col(text))).select(text).mapInArrow(count, "feature bigint, n bigint")
    rows = sums.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES + 1 rows
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int) -> np.ndarray:
    """Weights after ``epochs`` over ``rows`` of features, values and class."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, x, label in rows:
            w = weights(at)
            p = _softmax((x @ w)[None, :])[0]
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    return weights(slice(None))


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_label: int = PER_LABEL,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    at_once: int = AT_ONCE,
    examples: int = EXAMPLES,
) -> Tree | None:
    """Learn from every row of ``docs`` with a language and a letter; None if there is none."""
    usable = docs.where(F.col(lang).isNotNull()).where(has_letter(F.col(text)))
    counts = usable.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    labels = sorted(r[lang] for r in counts)
    if not labels:
        return None
    width = max(at_once, math.isqrt(len(labels) - 1) + 1)
    members = [labels[a : a + width] for a in range(0, len(labels), width)]
    chooser = len(members)  # the number of the softmax that chooses a group; the groups' own come before it
    seen, total = document_frequency(usable, text)
    idf = (np.log((1.0 + total) / (1.0 + seen)) + 1.0) * SCALE

    share = {r[lang]: min(1.0, per_label / r["n"]) for r in counts}
    shares = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
    place = F.create_map(*[F.lit(v) for kv in enumerate(labels) for v in reversed(kv)])
    drawn_of = {r[lang]: min(r["n"], per_label) for r in counts}
    in_group = max(sum(drawn_of[v] for v in group) for group in members)
    # Shards that are fitted, for a group's softmax and for the chooser's.
    inner, outer = (max(shards, -(-n // examples)) for n in (in_group, sum(drawn_of.values())))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    drawn = usable.where(hashing.uniform(1, "language sample", name) < F.coalesce(F.element_at(shares, F.col(lang)), F.lit(0.0)))
    # Shards beyond those that are fitted calibrate.
    sample = drawn.select(
        hashing.draw_index(inner + max(1, inner // 4), 1, "language shard", name).cast("int").alias("inner"),
        hashing.draw_index(outer + max(1, outer // 4), 1, "language shard", name).cast("int").alias("outer"),
        hashing.uniform(1, "language order", name).alias("place"),
        F.element_at(place, F.col(lang)).alias("label"),
        F.col(text).alias("text"),
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            at, values = [], []
            for _, features, bounds in grams.batches(batch.column("text")):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    found, n = np.unique(features[a:b], return_counts=True)
                    at.append(found), values.append(n / max(1, b - a))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                names=["inner", "outer", "place", "label", "features", "shares"],
            )

    fields = "inner int, outer int, place double, label int, features array<int>, shares array<double>"
    stored = scale.materialise(sample.mapInArrow(featured, fields), "language-sample")

    def of(node: Column, label: Column, shard: str, fitted: int) -> DataFrame:
        fit = (F.col(shard) < fitted).alias("fit")
        return stored.select(node.cast("int").alias("node"), F.col(shard).alias("shard"), fit, "place", label.cast("int").alias("label"), "features", "shares")

    group = F.floor(F.col("label") / width)
    learned = of(group, F.col("label") % width, "inner", inner)
    if chooser > 1:
        learned = learned.unionByName(of(F.lit(chooser), group, "outer", outer))
    names = [*members, *([[str(g) for g in range(chooser)]] if chooser > 1 else [])]
    sizes = [len(v) for v in names]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        node = int(rows["node"].iloc[0])
        size = sizes[node]
        found = [
            (np.append(f, FEATURES), np.append(s * idf[f], 1.0), int(y))
            for f, s, y in rows.sort_values(["place", "label"], kind="stable")[["features", "shares", "label"]].itertuples(index=False)
        ]
        w = ftrl(found, size, epochs)
        some = np.flatnonzero(w.any(axis=1))
        out = {"feature": np.repeat(some, size), "label": np.tile(np.arange(size), len(some)), "w": w[some].ravel()}
        return pd.DataFrame({"node": node, **out})

    fitted = learned.where("fit").groupBy("node", "shard").applyInPandas(fit, "node int, feature bigint, label bigint, w double")
    summed = fitted.groupBy("node", "feature", "label").agg(F.sum("w").alias("w")).where("w <> 0")
    summed = scale.materialise(summed, "language-weights")
    used = dict(learned.where("fit").groupBy("node").agg(F.countDistinct("shard")).collect())  # a row per group
    models = [_weighted(v, summed.where(F.col("node") == k), used.get(k, 1), idf) for k, v in enumerate(names)]
    for k, model in enumerate(models):
        model.temperature = _temperature(model, learned.where((F.col("node") == k) & ~F.col("fit")))
    return Tree(models[:chooser], models[chooser] if chooser > 1 else None)


def _weighted(labels: list[str], summed: DataFrame, used: int, idf: np.ndarray) -> Model:
    rows = summed.select("feature", "label", "w").toPandas()  # features times the languages of a group at most
    table = np.zeros((FEATURES + 1, len(labels)))
    table[rows["feature"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)] = rows["w"].to_numpy() / used
    table[:-1] *= idf[:, None]
    return Model(labels, np.ascontiguousarray(table.T.astype(np.float32)))


def _temperature(model: Model, held: DataFrame) -> float:
    """The temperature of least loss over rows that were not fitted on; 1 if there are none."""

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            pairs = zip(rows["features"], rows["shares"], strict=True)
            logits = np.stack([model.table[:, f] @ s for f, s in pairs]) + model.table[:, -1]
            truth = rows["label"].to_numpy()
            for k, t in enumerate(TEMPERATURES):
                p = _softmax(logits / t)[np.arange(len(rows)), truth]
                yield pd.DataFrame({"k": [k], "loss": [float(-np.log(np.maximum(p, 1e-12)).sum())]})

    loss = held.mapInPandas(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).toPandas()
    return float(TEMPERATURES[loss.sort_values(["loss", "k"])["k"].iloc[0]]) if len(loss) else 1.0


def _scored(source: DataFrame, carried: list[str], text: str, tree: Tree, first: int, last: int) -> DataFrame:
    """``carried``, ``_pred`` and ``_score`` after the languages of groups ``first`` to ``last`` are scored as well."""
    shared = source.sparkSession.sparkContext.broadcast((tree.groups[first:last], tree.chooser))
    so_far = first > 0
    types = {f.name: f for f in source.schema.fields}
    schema = T.StructType([*[types[c] for c in carried], *T.StructType.fromDDL("_pred string, _score double").fields])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (groups, chooser) = Grams(), shared.value
        known = [v for g in groups for v in g.labels]
        labels = pa.array([*known, UNKNOWN])
        for batch in batches:
            some = np.asarray(batch.column("_some"))
            best, score = np.full(batch.num_rows, len(known)), np.zeros(batch.num_rows)
            for start, features, bounds in grams.batches(batch.column(text)):
                weigh = chooser.probabilities(features, bounds) if chooser else None
                p = np.hstack([g.probabilities(features, bounds) * (1.0 if weigh is None else weigh[:, [first + k]]) for k, g in enumerate(groups)])
                at = slice(start, start + len(p))
                best[at] = np.where(some[at], p.argmax(axis=1), len(known))
                score[at] = np.where(some[at], p.max(axis=1), 0.0)
            pred = labels.take(pa.array(best))
            if so_far:
                before = np.asarray(batch.column("_score"))
                pred = pc.if_else(pa.array(score > before), pred, batch.column("_pred"))
                score = np.maximum(score, before)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pred, pa.array(score)], names=schema.fieldNames())

    return source.mapInArrow(scored, schema)


def predict(docs: DataFrame, tree: Tree | None, keep: list[str], text: str = "text", groups_a_pass: int = GROUPS_A_PASS) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row, in this order; names in ``keep`` may be anything."""
    inner = [f"_k{i}" for i in range(len(keep))]
    # The text goes to the tasks once, also where it is kept.
    read = inner[keep.index(text)] if text in keep else "_text"
    source = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)],
        *([] if text in keep else [F.col(text).alias("_text")]),
        has_letter(F.col(text)).alias("_some"),
    )
    outer = [*keep, "lang_pred", "score"]
    if tree is None:
        return source.select(*inner, F.lit(UNKNOWN), F.lit(0.0)).toDF(*outer)
    everything = source.columns
    for first in range(0, len(tree.groups), groups_a_pass):
        last = first + groups_a_pass
        if last < len(tree.groups):
            source = scale.materialise(_scored(source, everything, read, tree, first, last), "language-scores")
        else:
            source = _scored(source, inner, read, tree, first, last)
    return source.toDF(*outer)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, then predict all of them."""
    tree = train(docs.where(~held_out(F.col(key))).select(key, text, lang), key, text, lang)
    return predict(docs, tree, keep or [key], text)


def accepted(docs: DataFrame, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The documents with an identified language of at least that probability; columns as given."""
    found = identify(docs, key, keep=docs.columns)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = found.toDF(*names, "_pred", "_score").where((F.col("_pred") != UNKNOWN) & (F.col("_score") >= least))
    return plain.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
