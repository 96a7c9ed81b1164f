"""Exact top-K scoring: nearest neighbours, analogies, bilingual lexicon induction.

Candidates are scored in blocks and each task keeps only the K best per query, so the score matrix never
exists. Ties are broken by the word.

Up to ``QUERY_ROWS`` queries go to every task that scans candidates. More are joined with shelves: each candidate is
dealt to one shelf of its group, and queries are copied to the shelves of their group. A task reads a shelf, then
lets queries pass by in batches, so it holds one shelf however many queries there are. Where shelves as
large as a task can hold would be fewer than the tasks, there are more of them, or they are read by several lanes of queries, whichever
copies fewer rows. Inside a shelf candidates lie in clusters; a cluster is skipped for a query when
its centre and radius prove that it has nothing above the K-th best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.operators.embedding import WORD, EmbeddingModel
from lexloom.plans import scale

QUERY_ROWS = 4096  # most queries that every task receives
SHELF_BYTES = 64 * 1024 * 1024  # vectors of a shelf
_CLUSTERS = 256  # of a shelf
_BLOCK = 1024  # candidates or queries scored at once inside a task
_OUT = "qid bigint, word string, score double"
_DIGITS = 9  # scores equal to this many decimals are ties


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int, dim: int, limit: int | None = None
) -> DataFrame:
    """The ``k`` best candidates per query by dot product: ``(qid, rank, word, score)``.

    ``queries(qid, grp, vec)`` are compared with the ``candidates(word, grp, vec)`` of the same
    ``grp`` (a string; use '' for no grouping). Up to ``limit`` queries are sent to the tasks that
    scan the candidates; more are joined with shelves of candidates.
    """
    limit = QUERY_ROWS if limit is None else limit
    queries = scale.materialise(queries.select("qid", "grp", "vec"), "queries")
    candidates = candidates.select("word", "grp", "vec")
    if queries.limit(limit + 1).count() <= limit:
        best = _scan(queries, candidates, k, dim)
    else:
        best = _shelved(queries, scale.materialise(candidates, "candidates"), k, dim)
    by_query = W.partitionBy("qid").orderBy(F.desc("score"), "word")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


class Best:
    """The K best words of some queries so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.word = np.full((queries, k), None, dtype=object)

    def offer(self, rows: np.ndarray, scores: np.ndarray, words: np.ndarray) -> None:
        """Scores of the queries ``rows`` (distinct) with ``words``."""
        k = self.score.shape[1]
        scores = np.round(scores, _DIGITS) + 0.0
        floor = self.score[rows, -1]
        if scores.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        # What is tied with the last one is kept for the word order.
        at, column = np.nonzero(scores >= floor[:, None])
        if not len(at):
            return
        touched, of = np.unique(at, return_inverse=True)
        mine = rows[touched]
        old, slot = np.nonzero(self.score[mine] > -np.inf)
        row = np.concatenate([old, of])
        score = np.concatenate([self.score[mine[old], slot], scores[at, column]])
        word = np.concatenate([self.word[mine[old], slot], words[column]])
        order = np.lexsort((np.unique(word, return_inverse=True)[1], -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.score[mine[row[keep]], place[keep]] = score[order[keep]]
        self.word[mine[row[keep]], place[keep]] = word[order[keep]]

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        at, slot = np.nonzero(self.score > -np.inf)
        columns = [pa.array(qid[at], pa.int64()), pa.array(self.word[at, slot], pa.string()), pa.array(self.score[at, slot])]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "word", "score"])


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def _strings(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _scan(queries: DataFrame, candidates: DataFrame, k: int, dim: int) -> DataFrame:
    table = queries.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (table.column("qid").to_numpy(), _strings(table.column("grp")), _matrix(table.column("vec"), dim))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, grp, matrix = shared.value
        best = Best(len(qid), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                words, groups, vecs = _strings(part.column("word")), _strings(part.column("grp")), _matrix(part.column("vec"), dim)
                for g in set(groups):
                    mine, theirs = np.flatnonzero(grp == g), np.flatnonzero(groups == g)
                    if len(mine):
                        best.offer(mine, matrix[mine] @ vecs[theirs].T, words[theirs])
        yield best.rows(qid)

    return candidates.mapInArrow(run, _OUT)


class Shelf:
    """Candidates in clusters, each with its centre and the distance of its farthest member."""

    def __init__(self, words: np.ndarray, vecs: np.ndarray):
        pivots = vecs[:: max(1, -(-len(vecs) // min(_CLUSTERS, max(1, int(len(vecs) ** 0.5)))))]
        far = (pivots**2).sum(axis=1)
        nearest = np.concatenate([np.argmin(far - 2 * vecs[lo : lo + _BLOCK] @ pivots.T, axis=1) for lo in range(0, len(vecs), _BLOCK)])
        order = np.argsort(nearest, kind="stable")
        self.words, self.vecs = words[order], vecs[order]
        starts = np.flatnonzero(np.r_[True, np.diff(nearest[order]) != 0])
        ends = np.r_[starts[1:], len(order)]
        self.parts = [slice(a, min(a + _BLOCK, e)) for s, e in zip(starts, ends) for a in range(s, e, _BLOCK)]
        self.centres = np.stack([self.vecs[p].mean(axis=0) for p in self.parts])
        self.radii = np.array([np.sqrt(((self.vecs[p] - c) ** 2).sum(axis=1).max()) for p, c in zip(self.parts, self.centres)])

    def search(self, queries: np.ndarray, k: int) -> Best:
        best = Best(len(queries), k)
        # No member can be nearer than the centre and the radius allow; the last digit is given away for rounding.
        bound = queries @ self.centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii + 10.0**-_DIGITS
        bound += 1e-12 * np.abs(bound)
        for j in np.argsort(-bound.mean(axis=0), kind="stable"):
            rows = np.flatnonzero(bound[:, j] >= best.score[:, -1])
            if len(rows):
                best.offer(rows, queries[rows] @ self.vecs[self.parts[j]].T, self.words[self.parts[j]])
        return best


def shape(candidates: int, queries: int, tasks: int, dim: int) -> tuple[int, int]:
    """Shelves and lanes: no shelf above ``SHELF_BYTES``, about ``tasks`` pairs of both, and as few copied rows as that allows."""
    least = max(1, -(-8 * dim * candidates // SHELF_BYTES))
    balanced = math.ceil(math.sqrt(tasks * candidates / max(1, queries)))
    shelves = max(least, min(tasks, balanced, max(1, candidates)))
    return shelves, max(1, -(-tasks // shelves))


def _shelved(queries: DataFrame, candidates: DataFrame, k: int, dim: int) -> DataFrame:
    """Neither side fits in a task: candidates are dealt once, queries are copied to the shelves of their group."""
    spark = queries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = scale.materialise(candidates.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    total, asked = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], queries.count()
    wanted, lanes = shape(total, asked, parts, dim)
    shelves = F.ceil(F.col("n") * wanted / max(total, 1)).cast("int").alias("shelves")
    shelves = scale.materialise(counts.select("grp", shelves), "shelves")
    # Groups without candidates have no shelves, and their queries no answers.
    dealt = scale.lookup_join(candidates, shelves, ["grp"]).select(
        "grp", F.pmod(F.xxhash64("word"), F.col("shelves")).cast("int").alias("shelf"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("qid"), "word", "vec",
    )
    asking = scale.lookup_join(queries, shelves, ["grp"]).select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"),
        F.pmod(F.xxhash64("qid"), F.lit(lanes)).cast("int").alias("lane"),
        F.lit(True).alias("asks"), "qid", F.lit(None).cast("string").alias("word"), "vec",
    )
    place = ["grp", "shelf", "lane"]
    met = dealt.unionByName(asking).repartition(4 * parts, *place).sortWithinPartitions(*place, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, shelf = None, [], None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "shelf", "lane", "asks"))))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (*place, asks) = batch.slice(lo, hi - lo), places[lo]
                if place != here:
                    here, held, shelf = place, [], None
                if not asks:
                    held.append((_strings(part.column("word")), _matrix(part.column("vec"), dim)))
                    continue
                if shelf is None and held:
                    shelf, held = Shelf(*(np.concatenate(x) for x in zip(*held))), []
                if shelf is not None:
                    for at in range(0, part.num_rows, _BLOCK):
                        some = part.slice(at, _BLOCK)
                        yield shelf.search(_matrix(some.column("vec"), dim), k).rows(some.column("qid").to_numpy())

    return met.mapInArrow(run, _OUT)


def _wide(ranked: DataFrame, by: list[str], k: int, prefix: str, start: int = 1) -> DataFrame:
    """One column per rank."""
    wide = ranked.groupBy(*by).pivot("rank", list(range(1, k + 1))).agg(F.first("word"))
    names = [F.col(str(r)).alias(f"{prefix}{r - 1 + start}") for r in range(1, k + 1)]
    return wide.select(*by, *names)


def nearest_neighbors(
    model: EmbeddingModel, words: DataFrame, k: int = 25, wide: bool = False, limit: int | None = None
) -> DataFrame:
    """The ``k`` words closest by cosine to each of ``words(key)``, none of which is offered itself.

    Unknown words are skipped. Long rows ``(target, rank, word, score)``, or one row per target.
    """
    named = model.vectors(WORD).select("key", "ix", vectors.unit(F.col("vec")).alias("vec"))
    wanted = scale.materialise(words.select("key").distinct(), "wanted")
    nothing = F.lit("").alias("grp")
    queries = scale.lookup_join(named, wanted, ["key"], how="left_semi")
    others = scale.lookup_join(named, wanted, ["key"], how="left_anti")
    best = top_k(
        queries.select(F.col("ix").alias("qid"), nothing, "vec"),
        others.select(F.col("key").alias("word"), nothing, "vec"),
        k, model.dim, limit,
    )
    targets = model.keys.select(F.col("ix").alias("qid"), F.col("key").alias("target"))
    out = best.join(targets, on="qid").select("target", "rank", "word", "score")
    return _wide(out, ["target"], k, "@") if wide else out


def _word_vectors(model: EmbeddingModel, name: str) -> DataFrame:
    return model.vectors(WORD).select(F.col("key").alias(name), F.col("vec").alias(f"_{name}"))


def evaluate_analogy(
    model: EmbeddingModel,
    analogies: DataFrame,
    k: int = 25,
    cosine: bool = False,
    exclude_inputs: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """``w1 - w2 + w3`` against all words for ``analogies(row_id, w1, w2, w3, w4)``.

    Returns ``(row_id, w1, w2, w3, w4, guesses, correct)``; rows with an unknown word drop out. The
    score is the dot product with the plain vectors (``cosine`` normalises them), and the input words
    may be guessed unless ``exclude_inputs``.
    """
    names = ["w1", "w2", "w3", "w4"]
    known = analogies.select("row_id", *[F.col(n).cast("string").alias(n) for n in names])
    for name in names:
        known = scale.lookup_join(known, _word_vectors(model, name), [name], dim=model.dim)
    known = scale.materialise(known, "analogies")
    aim = vectors.add(vectors.subtract(F.col("_w1"), F.col("_w2")), F.col("_w3"))
    vec = F.col("vec")
    best = top_k(
        known.select(F.col("row_id").alias("qid"), F.lit("").alias("grp"), vectors.unit(aim).alias("vec")),
        model.vectors(WORD).select(
            F.col("key").alias("word"), F.lit("").alias("grp"),
            (vectors.unit(vec) if cosine else vec).alias("vec"),
        ),
        k + 3 if exclude_inputs else k, model.dim, limit,
    )
    guesses = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).getField("word").alias("guesses")
    )
    out = known.join(guesses, known["row_id"] == guesses["qid"])
    if exclude_inputs:
        out = out.withColumn("guesses", F.slice(F.array_except("guesses", F.array("w1", "w2", "w3")), 1, k))
    return out.select("row_id", *names, "guesses", F.array_contains("guesses", F.col("w4")).alias("correct"))


def bli_skipped_pairs(pairs: DataFrame, model: EmbeddingModel) -> DataFrame:
    """Pairs of which one word is not in the model."""
    words = model.keys.where(F.col("role") == WORD)
    known = pairs
    for side in ("source", "target"):
        seen = words.select(F.col("key").alias(side), F.lit(True).alias(f"_{side}"))
        known = scale.lookup_join(known, seen, [side], how="left")
    return known.where("_source is null or _target is null").select("source", "target")


def bilingual_lexicon_induction(
    pairs: DataFrame,
    model: EmbeddingModel,
    precision: tuple[int, ...] = (1, 5, 15),
    reverse: bool = False,
    wide: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Rank the words of the target's label by cosine with the source word.

    ``pairs(source, target)`` hold full keys (``word_label``). Each row gets ``p@n`` (is the target
    among the first n) and ``guesses``. Pairs with an unknown word are skipped.
    """
    if reverse:
        pairs = bli_reverse(pairs)
    words = model.keys.where(F.col("role") == WORD)
    named = model.vectors(WORD).select("key", "label", vectors.unit(F.col("vec")).alias("vec"))
    source = named.select(F.col("key").alias("source"), "vec")
    target = words.select(F.col("key").alias("target"), F.col("label").alias("grp"))
    known = scale.lookup_join(pairs.select("source", "target"), target, ["target"])
    known = scale.materialise(known, "lexicon")
    # Sources are ranked once per target language, however many translations they have.
    asked = known.select("source", "grp").distinct()
    asked = scale.dense_index(scale.lookup_join(asked, source, ["source"], dim=model.dim), ["source", "grp"], "qid")
    asked = scale.materialise(asked, "asked")
    k = max(precision)
    best = top_k(asked, named.select(F.col("key").alias("word"), F.col("label").alias("grp"), "vec"), k, model.dim, limit)
    guesses = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).getField("word").alias("guesses")
    )
    out = known.join(asked.select("source", "grp", "qid"), on=["source", "grp"]).join(guesses, on="qid")
    place = F.array_position("guesses", F.col("target"))
    hits = [((place > 0) & (place <= p)).alias(f"p@{p}") for p in precision]
    if not wide:
        return out.select("source", "target", *hits, "guesses")
    each = [F.try_element_at("guesses", F.lit(g + 1)).alias(f"guess-{g}") for g in range(k)]
    return out.select("source", "target", *hits, *each)


def bli_reverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
