from pyspark.sql import functions as F

from lexloom.llm import exact_dedup, simhash
from lexloom.llm.common import numbered


def test_rows_that_an_explode_repeats_have_identities_of_their_own(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "concat('text number ', id) AS text").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    twice = read.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    for docs in (twice, read.union(read), spark.read.parquet(*[str(tmp_path / "t")] * 2)):
        rows = numbered(docs, "row")
        assert rows.count() == rows.select("row").distinct().count() == docs.count()
    assert exact_dedup.without_copies(twice).count() == 50
    assert simhash.without_near_copies(twice).count() == simhash.without_near_copies(read).count()


def test_a_plain_read_is_not_stored_again(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "'a' AS text").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for docs in (read, read.select("text").where("text > ''"), read.alias("x")):
        assert numbered(docs, "row").inputFiles() == read.inputFiles()
