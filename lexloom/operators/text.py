"""Text preprocessing: tokens, counts, rare-word filter, downsampling, labelled partitions.

A token table has the document key columns, ``tok`` (place in the document), ``word`` and
``label`` ('' when the corpus is not partitioned). A corpus is ``(pos, word, label)`` with
``pos`` dense from 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import hashing, text
from lexloom.plans import scale


class Prepared(NamedTuple):
    corpus: DataFrame
    vocab: DataFrame


def tokenize(
    docs: DataFrame,
    key: list[str],
    text_col: str = "text",
    label: Column | str | None = None,
    lowercase: bool = True,
    strip: str = "",
    drop_non_word_runs: bool = False,
) -> DataFrame:
    """One row per whitespace-separated token of each document."""
    if label is None:
        label = F.lit("")
    elif isinstance(label, str):
        label = F.col(label)
    words = document_words(docs, key, text_col, label, lowercase, strip, drop_non_word_runs)
    # Rows of empty texts go afterwards: Spark would first ask of every text, and split it for that, whether it has words.
    each = words.select(*key, "label", F.posexplode_outer("words").alias("tok", "word")).where("tok is not null")
    # No word is null, which Spark has to know: else a join on stripped words strips them twice.
    return each.select(*key, "tok", F.coalesce("word", F.lit("")).alias("word"), "label")


def document_words(
    docs: DataFrame, key: list[str], text_col: str = "text", label: Column | None = None, lowercase: bool = True, strip: str = "", drop_non_word_runs: bool = False
) -> DataFrame:
    """One row per document with its ``words`` in their order, and its label if one is given."""
    body = F.col(text_col)
    if drop_non_word_runs:
        body = text.drop_non_word_runs(body)
    if lowercase:
        body = F.lower(body)
    if strip:
        body = text.strip_characters(body, strip)
    labels = [] if label is None else [label.cast("string").alias("label")]
    bodies = scale.spread_small(docs.select(*key, *labels, body.alias("_body")), key)
    return bodies.select(*key, *(["label"] if labels else []), text.split_words(F.col("_body")).alias("words"))


def lowercase_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("word", F.lower("word"))


def strip_punctuation(tokens: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Delete ``. , ! ?`` inside tokens; a token that becomes empty stays unless dropped."""
    out = tokens.withColumn("word", text.strip_characters(F.col("word")))
    return out.where(F.col("word") != "") if drop_empty else out


def strip_chars(docs: DataFrame, chars: str, text_col: str = "text") -> DataFrame:
    """Delete the given characters from the text before it is split."""
    return docs.withColumn(text_col, text.strip_characters(F.col(text_col), chars))


def token_positions(tokens: DataFrame, order: list[str], kept: list[str] | None = None) -> DataFrame:
    """Dense position of every token over all documents in order, with all columns or those ``kept``."""
    return scale.dense_index(tokens, order, "pos", kept)


def word_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences per word over all partitions together."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def label_name(word: Column, label: Column) -> Column:
    """Display form of a labelled word: ``word_label``, or the bare word without a label."""
    return F.when(label == "", word).otherwise(F.concat_ws("_", word, label))


def label_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("key", label_name(F.col("word"), F.col("label")))


def _keep_words(tokens: DataFrame, keep_words) -> DataFrame | None:
    """Kept words as a one-column table, from a collection or a DataFrame ``(word)``."""
    if keep_words is None:
        return None
    if isinstance(keep_words, DataFrame):
        return keep_words.select("word").distinct()
    words = [(w,) for w in sorted(set(keep_words))]
    return tokens.sparkSession.createDataFrame(words, "word string") if words else None


def filter_counts(counts: DataFrame, limit: int = 5, keep_words=None) -> DataFrame:
    """Counts of the words seen at least ``limit`` times or named in ``keep_words``."""
    kept = _keep_words(counts, keep_words)
    if kept is None:
        return counts.where(F.col("n") >= limit)
    marked = counts.join(kept.withColumn("_kept", F.lit(True)), on="word", how="left")
    return marked.where((F.col("n") >= limit) | F.col("_kept")).drop("_kept")


def _corpus_size(counts: DataFrame) -> int:
    return int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _with_counts(tokens: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Attach ``n``, and what else ``counts`` has, to every token whose word is in it; words without a count drop out."""
    hot = counts.where(F.col("n") * scale.HOT_SHARE > F.lit(size))
    # A chance and its bar fit into the room that every row is given for its word.
    return scale.lookup_join(tokens, counts, ["word"], hot=hot, fits=scale.fits_broadcast(counts.select("word", "n")))


def filter_rare_words(
    tokens: DataFrame, limit: int = 5, keep_words=None
) -> tuple[DataFrame, DataFrame]:
    """Tokens of the kept words, and the kept words' counts."""
    counts = scale.materialise(word_counts(tokens), "counts")
    kept = scale.materialise(filter_counts(counts, limit, keep_words), "kept-counts")
    return _with_counts(tokens, kept, _corpus_size(counts)).drop("n"), kept


def keep_probability(n: Column, size: int, cutoff: float) -> Column:
    """sqrt(cutoff / f), at most 1, for a word that makes up the share f of the corpus."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(cutoff)) / (n / F.lit(float(size)))))


def downsample_common_words(
    tokens: DataFrame, counts: DataFrame, key: list[str], cutoff: float = 1e-5, seed: int = 0
) -> DataFrame:
    """Drop each token with probability 1 - sqrt(cutoff / frequency)."""
    size = _corpus_size(counts)
    return _thin(_with_counts(tokens, _with_chances(counts, size, cutoff), size), key, seed)


def _with_chances(counts: DataFrame, size: int, cutoff: float) -> DataFrame:
    """Counts with the chance to be kept and the bar of the draw, which are worked out per word, not per token."""
    keep = keep_probability(F.col("n"), size, cutoff)
    return counts.withColumns({"_keep": keep, "_bar": F.when(keep < 1, hashing.chance_bar(keep))})


def _thin(counted: DataFrame, key: list[str], seed: int) -> DataFrame:
    # A draw is below 1, so words that are kept anyway need none.
    drawn = hashing.happens(F.col("_bar"), seed, "downsample", *[F.col(k) for k in key])
    return counted.where((F.col("_keep") >= 1) | drawn).drop("n", "_keep", "_bar")


def _prepare(tokens, order, key, keep_words, limit, downsample, cutoff, seed):
    """Rare filter and downsampling in one pass after the counting pass, then positions."""
    counts = scale.materialise(word_counts(tokens), "counts")
    kept = scale.materialise(filter_counts(counts, limit, keep_words), "kept-counts")
    chances = scale.materialise(_with_chances(kept, _corpus_size(kept), cutoff), "chances") if downsample else kept
    counted = _with_counts(tokens, chances, _corpus_size(counts))
    if downsample:
        counted = _thin(counted, key, seed)
    # Written before they are ordered: finding the range bounds reads the rows a second time, and
    # the kept tokens are far fewer than the text they come from.
    # They have been placed, in a table of their own, when they are deleted.
    with scale.kept_until_the_end(counted.select(*order, "word", "label"), "kept-tokens") as thin:
        corpus = token_positions(thin, order, ["word", "label"])
    return corpus.select("pos", "word", "label"), counts, kept


def preprocess_standard(
    tokens: DataFrame,
    key: list[str],
    keep_words=None,
    limit: int = 5,
    downsample: bool = True,
    cutoff: float = 1e-5,
    seed: int = 0,
) -> Prepared:
    """Rare filter, downsampling, and the vocabulary with frequencies n / (all raw tokens).

    ``key`` identifies and orders the tokens, for example ``["doc_id", "tok"]``.
    """
    tokens = tokens.withColumn("label", F.lit(""))
    corpus, counts, kept = _prepare(tokens, key, key, keep_words, limit, downsample, cutoff, seed)
    size = float(_corpus_size(counts))
    present = corpus.select("word", "label").distinct()
    vocab = present.join(kept, on="word").select(
        "word", "label", "n", (F.col("n") / F.lit(size)).alias("freq")
    )
    return Prepared(corpus, scale.materialise(vocab, "vocab"))


def partitioned_frequencies(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """Per ``(word, label)`` the global count of the word, normalised over all entries to sum 1."""
    entries = corpus.select("word", "label").distinct()
    # A common word has an entry in most partitions.
    vocab = scale.materialise(scale.lookup_join(entries, counts, ["word"]), "vocab")
    total = float(_corpus_size(vocab))
    return vocab.select("word", "label", "n", (F.col("n") / F.lit(total)).alias("freq"))


def preprocess_partitioned(
    tokens: DataFrame,
    key: list[str],
    part: list[str],
    labelled: bool = True,
    lowercase: bool = True,
    remove_punctuation: bool = True,
    keep_words=None,
    limit: int = 5,
    downsample: bool = True,
    cutoff: float = 1e-5,
    seed: int = 0,
) -> Prepared:
    """Preprocessing for labelled partitions, which are laid out one after the other.

    ``part`` are the columns that order the partitions (before ``key``); with
    ``labelled=False`` words stay bare and the partitions share one vocabulary.
    """
    if lowercase:
        tokens = lowercase_tokens(tokens)
    if remove_punctuation:
        tokens = strip_punctuation(tokens)
    if not labelled:
        tokens = tokens.withColumn("label", F.lit(""))
    order = list(dict.fromkeys([*part, *key]))
    corpus, _, kept = _prepare(tokens, order, key, keep_words, limit, downsample, cutoff, seed)
    return Prepared(corpus, partitioned_frequencies(corpus, kept))


def empty_partitions(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Labels of which no token is left."""
    return labels.select("label").distinct().join(
        corpus.select("label").distinct(), on="label", how="left_anti"
    )


def contiguous_split(
    corpus: DataFrame, size: int, fractions: tuple[float, ...] = (0.7, 0.15, 0.15)
) -> list[DataFrame]:
    """Cut the corpus by position into consecutive parts, each with its own dense positions."""
    bounds, share = [0], 0.0
    for fraction in fractions[:-1]:
        share += fraction
        bounds.append(int(share * size + 1e-9))
    bounds.append(size)
    return [
        corpus.where((F.col("pos") >= lo) & (F.col("pos") < hi)).withColumn(
            "pos", F.col("pos") - F.lit(lo)
        )
        for lo, hi in zip(bounds, bounds[1:])
    ]
