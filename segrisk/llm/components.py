"""Connected components of a table of links, by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.session import materialise, temporary


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (columns a, b); component is the smallest id that links reach.

    Each round takes the smallest label among the neighbours and then the label of the label, so that long chains
    take a number of rounds that grows with the logarithm of their length. Both steps are joins and aggregations with
    partial results; every round is written to the shared folder, so nothing is computed twice and lost executors
    cost one round at most. Only the result stays there. Links with NULL and links of an id with itself are ignored.
    """
    with temporary(links.sparkSession) as keep:
        links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = materialise(both, "links")
        labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        labels = materialise(labels.select("id", F.least("id", "low").alias("label")), "labels")
        while True:
            near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
            lower = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
            lower = materialise(lower, "labels")
            jump = lower.select(F.col("id").alias("at"), F.col("label").alias("next"))
            moved = lower.join(jump, lower.label == jump.at).select("id", F.least("label", "next").alias("label"), "old")
            moved = materialise(moved, "labels")
            labels = moved.select("id", "label")
            if moved.where("label <> old").isEmpty():
                return keep(labels.withColumnRenamed("label", "component"), "components")
