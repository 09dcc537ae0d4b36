import pytest
from pyspark.sql import functions as F

from segrisk.operators.joins import join_by_id


@pytest.mark.parametrize("id_rows", [3, 40, 10**6])
def test_equals_a_plain_join(spark, id_rows):
    rows = spark.range(0, 300, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("k"),
        (F.col("id") % 2).alias("v"),
    )
    by_id = spark.createDataFrame([(7, "a"), (7, "b"), (4, "c"), (None, "n"), (99, "z")], "k long, w string")
    joined = join_by_id(rows, by_id, "k", id_rows=id_rows)
    assert joined.columns == ["k", "v", "w"]
    r = rows.alias("r")
    plain = r.join(by_id.alias("b"), F.expr("r.k <=> b.k"), "left").select("r.k", "r.v", "w")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_hot_id_is_spread(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(1).cast("bigint").alias("k"), F.lit(0).alias("v"))
    by_id = spark.createDataFrame([(1, "a")], "k long, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_by_id(rows, by_id, "k", id_rows=100)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 4000


def test_hot_id_in_one_input_partition_is_spread(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("v"))
    by_id = spark.createDataFrame([(1, "a")], "k long, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_by_id(rows, by_id, "k", id_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 3000


def test_equal_rows_in_one_input_partition_are_dealt_evenly(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.lit(1).cast("bigint").alias("k"), F.lit("same").alias("v"))
    by_id = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        joined = join_by_id(rows, by_id, "k", id_rows=100)
        salted = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["count"] for r in salted]
    assert sum(sizes) == 4000 and len(sizes) >= 33 and max(sizes) <= 400  # 40 salts, some of which share a task


def test_any_number_of_hot_ids(spark):
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 10_000).alias("k"), F.col("id").alias("v"))
    by_id = spark.range(0, 10_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    joined = join_by_id(rows, by_id, "k", id_rows=2)
    assert joined.where("w = k + 1").count() == 40_000
