"""Corpora and gold sets from files or tables.

A line of a file is known by the file's name below the folder that is read and by its number in the file. Both are the
same however the file is split among tasks and wherever the folder lies, so the draws that follow from them are too.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import text
from lexloom.plans import scale

# Key columns of a line read from files: the file's name below the folder read, and the line's number in it.
LINE_KEY = ["path", "line"]
SIMILARITY_SCHEMA = "word1 string, word2 string, similarity double"
_GLOB = set("*?[{")


def _folder(spark: SparkSession, path: str) -> str:
    """The path of the folder below which files are named: ``path`` itself, or the folder of a file or pattern."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fixed = named
    while fixed.getParent() is not None and _GLOB & set(fixed.toUri().getPath()):
        fixed = fixed.getParent()
    store = fixed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = store.makeQualified(fixed)
    if fixed.equals(named) and not store.getFileStatus(fixed).isDirectory():
        whole = whole.getParent()
    return whole.toUri().getPath().rstrip("/") + "/"


def _file_path(uri: Column) -> Column:
    """The plain path of a file's encoded URI."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


def numbered_lines(read: DataFrame, folder: str) -> DataFrame:
    """Rows read from files with ``path``, the name below ``folder``, and ``line``, the row's number in its file.

    A task reads the rows of a split one after another, so a row's number is its place in the split plus the rows of
    the splits before it, which are counted first; only the counts are kept, one row per split.
    """
    own = read.columns
    placed = read.select(
        "*",
        F.substring(_file_path(F.col("_metadata.file_path")), len(folder) + 1, 2**31 - 1).alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = placed.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    splits = scale.materialise(splits.select("path", "_split", before.alias("_shift")), "splits")
    line = (F.col("_at") + F.col("_shift")).alias("line")
    return scale.lookup_join(placed, splits, ["path", "_split"]).select("path", line, *own)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, ``(path, line, text)``; the key orders them as in the files."""
    return numbered_lines(spark.read.text(path), _folder(spark, path)).withColumnRenamed("value", "text")


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files as one token stream ``(pos, word, label)``, lower-cased; files follow each other by name."""
    tokens = text.tokenize(read_lines(spark, path), LINE_KEY)
    return text.token_positions(tokens, [*LINE_KEY, "tok"]).select("pos", "word", "label")


def file_stem(path: Column) -> Column:
    """File name without directories and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_partitioned_files(
    spark: SparkSession, path: str, label_pattern: str | None = None
) -> DataFrame:
    """Tokens of a directory of files, labelled by file stem, or by the first group of
    ``label_pattern`` in the file's name below the directory."""
    lines = read_lines(spark, path)
    if label_pattern is None:
        label = file_stem(F.col("path"))
    else:
        label = F.regexp_extract("path", label_pattern, 1)
    return text.tokenize(lines.withColumn("label", label), LINE_KEY, label="label")


def group_texts_by_label(docs: DataFrame, label: str, key: list[str], text_col: str = "text") -> DataFrame:
    """Tokens of a table of texts, grouped by label, with runs of punctuation before a blank deleted.

    The tokens keep ``label`` and ``key`` as their order; a label's texts are never joined into one
    string, so words of different rows are never glued together.
    """
    return text.tokenize(docs, key, text_col, label=label, drop_non_word_runs=True)


def read_labelled_csv(
    spark: SparkSession, path: str, label: str = "year", text_col: str = "speech"
) -> DataFrame:
    """A CSV with a header, one text per row, grouped by its label column."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(F.col(label).alias("_label"), F.col(text_col).alias("_text"))
    rows = numbered_lines(rows, _folder(spark, path)).select("path", "line", F.col("_label").alias(label), F.col("_text").alias("text"))
    return group_texts_by_label(rows, label, LINE_KEY)


def read_similarity_set(
    spark: SparkSession, sets: dict[str, str] | list[str], skip_missing: bool = False
) -> DataFrame:
    """Tab-separated gold sets without a header, as ``(dataset, word1, word2, similarity)``.

    ``sets`` maps names to paths, or lists paths whose stems are the names.
    """
    if not isinstance(sets, dict):
        sets = {os.path.splitext(os.path.basename(p.rstrip("/")))[0]: p for p in sets}
    if not sets:
        raise ValueError("name at least one gold set")
    reader = spark.read.schema(SIMILARITY_SCHEMA).option("sep", "\t").option("quote", "")
    out = None
    for name, path in sets.items():
        try:
            rows = reader.csv(path)
        except Exception as missing:
            if skip_missing and "PATH_NOT_FOUND" in str(missing):
                continue
            raise
        rows = rows.select(F.lit(name).alias("dataset"), "word1", "word2", "similarity")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"none of the gold sets exists: {sorted(sets)}")
    return out
