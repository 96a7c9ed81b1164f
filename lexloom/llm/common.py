"""What several operators share: words, and a local binding for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans import scale

# A word is a run of anything but space and the control characters 9 to 13.
BLANKS = "[ \\t-\\r]+"
SQL_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def add(values: Column, kind: str = "bigint") -> Column:
    """Sum of an array; zero for an empty one."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until the table has no such column."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _plain_read(docs: DataFrame) -> bool:
    """Whether every row is a row of a file of its own: one read, its rows at most filtered and its columns computed."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if not node.nodeName().startswith("LogicalRelation") and not node.nodeName().startswith("Relation"):
        return False
    try:
        paths = node.relation().location().rootPaths()
    except Py4JError:  # not files
        return False
    return paths.distinct().size() == paths.size()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents with an identity per row, which tells apart rows that agree in everything.

    A plain read of files has one: the file and the row's place in it. Any other table, also one made from a read by
    explode, join or union, is stored with numbers.
    """
    if _plain_read(docs):
        try:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.withColumn(name, place)
        except AnalysisException:
            pass
    place = F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at"))
    return scale.materialise(docs.withColumn(name, place), "numbered")
