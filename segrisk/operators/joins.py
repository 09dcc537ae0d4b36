"""Left join of wide rows with a table by id, safe against an id that holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.session import materialise

# Rows of one id above which its rows are spread over several tasks.
ID_ROWS = 1_000_000


def join_by_id(rows: DataFrame, by_id: DataFrame, key: str, id_rows: int = ID_ROWS) -> DataFrame:
    """``rows`` with the columns of ``by_id``, a left join in which a missing id matches a missing id.

    Ids with more than ``id_rows`` rows are hot. Without any, this is a plain join. Rows of hot ids are dealt out in
    turns, also rows that are equal in everything, and the partition that a row is dealt to is its salt; the rows of
    ``by_id`` are repeated for the salts of their own id. The list of hot ids has at most one row per ``id_rows`` rows.
    """
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialise(counts.where(F.col("_rows") > id_rows).selectExpr("_hot", f"ceil(_rows / {id_rows}) AS _salts"), "hot_ids")
    most = hot.agg(F.max("_salts")).first()[0]
    named = by_id.withColumnRenamed(key, "_id")
    if not most:
        return rows.join(named, F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    plain = rows.join(hot, is_hot, "left_anti").join(named, F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")

    # Round robin over sorted partitions, so that a repeated task deals the same rows to the same places.
    dealt = rows.join(hot, is_hot, "left_semi").repartition(int(most)).withColumn("_place", F.spark_partition_id())
    salted = dealt.join(hot, is_hot).withColumn("_salt", F.pmod(F.col("_place").cast("bigint"), F.col("_salts")))
    salted = salted.drop("_place", "_hot", "_salts")
    repeated = named.join(hot, F.col("_id").eqNullSafe(F.col("_hot"))).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    )
    matches = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_salt") == F.col("_part"))
    spread = salted.join(repeated.drop("_hot", "_salts"), matches, "left").drop("_id", "_salt", "_part")
    return plain.unionByName(spread)
