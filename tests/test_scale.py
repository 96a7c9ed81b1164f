import os

import pytest
from pyspark.sql import functions as F

from lexloom.plans import scale


def test_folder_is_never_local_to_a_machine_on_a_cluster():
    assert scale.choose_folder("own", "cluster", "spark://h", "a") == "own"
    assert scale.choose_folder(None, "cluster", "spark://h", "a") == "cluster"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="executors share"):
            scale.choose_folder(None, None, master, "a")
    folder = scale.choose_folder(None, None, "local[4]", "a")
    assert os.path.isdir(folder) and scale.choose_folder("", None, "local", "a") == folder


def test_scratch_setting_wins_at_run_time(spark, tmp_path):
    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        scale.materialise(spark.range(3), "three")
        assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["three"]
    finally:
        spark.conf.unset(scale.SCRATCH)


def test_only_the_last_and_the_pinned_version_stay(spark, tmp_path):
    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        states, tables = scale.Versions("state"), []
        for k in range(5):
            tables.append(states.put(spark.range(k + 1)))
            if k in (0, 2):
                states.pin(spark)
        assert len(os.listdir(tmp_path)) == 2
        assert tables[2].count() == 3 and tables[4].count() == 5
    finally:
        spark.conf.unset(scale.SCRATCH)


def test_broadcasts_count_the_bytes_of_strings(spark):
    wide = spark.range(100).select("id", F.lit("x" * 10_000).alias("a.text"))
    assert scale.fits_broadcast(wide, limit=1_100_000) and not scale.fits_broadcast(wide, limit=900_000)
    assert not scale.fits_broadcast(wide, limit=2_000) and scale.fits_broadcast(wide.limit(0), limit=1)


def test_scopes_delete_what_is_stored_inside(spark, tmp_path):
    spark.conf.set(scale.SCRATCH, str(tmp_path))
    try:
        kept = scale.Versions("kept")
        with scale.scope(spark):
            outer = scale.materialise(spark.range(3), "outer")
            with scale.scope(spark):
                table = kept.put(scale.materialise(spark.range(4), "inner"))
            assert sorted(n.split("-")[0] for n in os.listdir(tmp_path)) == ["kept", "outer"] and outer.count() == 3
        assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["kept"] and table.count() == 4
        scale.materialise(spark.range(1), "free")
        assert len(os.listdir(tmp_path)) == 2
    finally:
        spark.conf.unset(scale.SCRATCH)


@pytest.mark.parametrize("parts", [1, 64, 200])
def test_identical_hot_rows_are_spread(spark, parts):
    big = spark.range(20000, numPartitions=parts).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    small = spark.createDataFrame([("hot", 2), ("cold", 3)], "k string, w int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.lookup_join(big, small, ["k"], limit=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20000 and len(sizes) == 4 and max(sizes) < 8000


def test_scopes_destroy_what_is_broadcast_inside(spark):
    outside = scale.shared(spark, [1])
    with scale.scope(spark):
        inside = scale.shared(spark, list(range(1000)))
        assert os.path.exists(inside._path)
    assert not os.path.exists(inside._path)
    assert os.path.exists(outside._path) and outside.value == [1]
    outside.destroy()
