"""Road attributes joined onto segments, and the features derived from them.

An element may have several attribute rows, and then the joins multiply a segment's rows. Here every attribute
table is first reduced to its distinct (element, value) rows with their number, and the joined row carries the
product of those numbers in ``copies``. Nothing is lost: ``expand_copies`` turns a row back into that many rows.
A value repeated a billion times for one element thereby crosses the shuffle as one row, and a segment id that
many rows share is joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrisk.functions.missing import as_double, exceeds
from segrisk.operators.joins import join_by_id
from segrisk.schemas import ELEMENT_ID, NUMBER_OF_LANES, ROAD_CLASS, SPEED_LIMIT

COPIES = "copies"
HIGH_SPEED = "high_speed"
SPEED_THRESHOLD = 50.0

# Rows one task may produce from a single row when copies are expanded.
EXPAND_BLOCK = 4096


def require_columns(df: DataFrame, *columns: str) -> None:
    """Fail with the column names before anything is planned."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise ValueError(f"column(s) {missing} not found; available: {df.columns}")


def with_copies(df: DataFrame) -> DataFrame:
    return df if COPIES in df.columns else df.withColumn(COPIES, F.lit(1).cast("bigint"))


def _reduce_attribute(attribute: DataFrame, value: str, dedup: str | None, order_by: str | None) -> DataFrame:
    if dedup is None:
        return attribute.groupBy(ELEMENT_ID, value).agg(F.count(F.lit(1)).alias("_n"))
    if dedup == "max":
        chosen = F.max(value)
    elif dedup == "first_by":
        if order_by is None:
            raise ValueError("dedup='first_by' needs order_by")
        # The value breaks ties, so the choice does not depend on the row order.
        chosen = F.min(F.struct(F.col(order_by), F.col(value))).getField(value)
    else:
        raise ValueError(f"dedup must be None, 'max' or 'first_by', got {dedup!r}")
    return attribute.groupBy(ELEMENT_ID).agg(chosen.alias(value)).withColumn("_n", F.lit(1).cast("bigint"))


def join_attribute(
    ids: DataFrame,
    attribute: DataFrame,
    value: str,
    *,
    key: str = "ogf_id",
    suffix: str = "",
    dedup: str | None = None,
    order_by: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Left join of one attribute table; its key column stays as ``orn_road_net_element_id`` + ``suffix``."""
    require_columns(attribute, ELEMENT_ID, value)
    right_key = ELEMENT_ID + suffix
    right = _reduce_attribute(attribute, value, dedup, order_by).withColumnRenamed(ELEMENT_ID, right_key)
    left, other = F.col(key), F.col(right_key)
    condition = left.eqNullSafe(other) if null_safe else left == other
    return (
        with_copies(ids)
        .join(right, condition, "left")
        .withColumn(COPIES, F.col(COPIES) * F.coalesce("_n", F.lit(1).cast("bigint")))
        .drop("_n")
    )


def attributes_by_id(
    ids: DataFrame,
    speed: DataFrame,
    lanes: DataFrame,
    road_class: DataFrame,
    *,
    dedup: str | None = None,
    order_by: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Speed limit, lane count and road class of each of the distinct ``ids``; ``copies`` holds the fan-out."""
    options = {"key": ids.columns[0], "dedup": dedup, "order_by": order_by, "null_safe": null_safe}
    df = join_attribute(ids, speed, SPEED_LIMIT, **options)
    df = join_attribute(df, lanes, NUMBER_OF_LANES, suffix="_lanes", **options)
    return join_attribute(df, road_class, ROAD_CLASS, suffix="_class", **options)


def attach_attributes(
    roads: DataFrame, speed: DataFrame, lanes: DataFrame, road_class: DataFrame, *, key: str = "ogf_id", **options
) -> DataFrame:
    """Speed limit, lane count and road class joined onto ``roads``; ``copies`` holds the fan-out.

    ``dedup`` keeps one row per element: the largest value ("max") or the first one in the order of the
    attribute tables' column ``order_by`` ("first_by"). ``null_safe`` also matches missing keys with each other.

    The attributes are joined onto the distinct ids, so the wide rows with their geometry are shuffled once.
    """
    require_columns(roads, key)
    taken = [c for c in (SPEED_LIMIT, NUMBER_OF_LANES, ROAD_CLASS) if c in roads.columns]
    if taken:
        raise ValueError(f"segments already have column(s) {taken}")
    by_id = attributes_by_id(roads.select(key).distinct(), speed, lanes, road_class, **options)
    joined = join_by_id(with_copies(roads), by_id.withColumnRenamed(COPIES, "_fan_out"), key)
    return joined.withColumn(COPIES, F.col(COPIES) * F.col("_fan_out")).drop("_fan_out")


def drop_prefixed(df: DataFrame, prefix: str = ELEMENT_ID, keep: str = "ogf_id") -> DataFrame:
    """Drop every column that starts with ``prefix`` except ``keep``."""
    names = [c for c in df.columns if c.lower().startswith(prefix.lower()) and c != keep]
    return df.drop(*names)


def lane_count(column: str = NUMBER_OF_LANES) -> Column:
    """Missing lane counts become 1; fractions are cut off."""
    return F.coalesce(as_double(column), F.lit(1.0)).cast("int")


def derive_features(df: DataFrame) -> DataFrame:
    """The high-speed flag, the filled lane count, and no leftover join keys."""
    features = df.withColumns(
        {HIGH_SPEED: exceeds(SPEED_LIMIT, SPEED_THRESHOLD), NUMBER_OF_LANES: lane_count()}
    )
    return drop_prefixed(features)


def segment_features(
    roads: DataFrame, speed: DataFrame, lanes: DataFrame, road_class: DataFrame, **options
) -> DataFrame:
    """Segments with attributes and derived features, one row per distinct combination and its ``copies``."""
    return derive_features(attach_attributes(roads, speed, lanes, road_class, **options))


def expand_copies(
    df: DataFrame, key: str = "ogf_id", block: int = EXPAND_BLOCK, number: str | None = None
) -> DataFrame:
    """Each row ``copies`` times, without the column ``copies``; with their running number in the column ``number``.

    Rows of at most ``block`` copies, as a rule all of them, are written out where they are. Others are first cut into
    blocks, in two steps so that no list of blocks is long, and the blocks are spread over the cluster before they
    expand, so no task writes out a whole group of copies.
    """

    def numbered(rows: DataFrame, name: str, size: int) -> DataFrame:
        """One row per part of ``size`` copies, with the copies of that part and those before it."""
        last = F.floor((F.col("_copies") - 1) / size)
        parts = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        left = F.col("_copies") - F.col(name) * size
        return parts.withColumn("_copies", F.least(F.lit(size).cast("bigint"), left))

    few = df.where((F.col(COPIES) > 0) & (F.col(COPIES) <= block))
    few = few.withColumns({"_copies": F.col(COPIES), "_before": F.lit(0).cast("bigint")})
    many = df.where(F.col(COPIES) > block).withColumn("_copies", F.col(COPIES))
    many = numbered(numbered(many, "_region", block * block), "_block", block)
    many = many.repartition(F.xxhash64(F.col(key), F.col("_region"), F.col("_block")))
    many = many.withColumn("_before", F.col("_region") * block * block + F.col("_block") * block)
    rows = few.unionByName(many.drop("_region", "_block"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    rows = rows.withColumn("_copy", copy)
    kept = [F.col(f"`{c}`") for c in df.columns if c != COPIES]
    return rows.select(*kept, *([(F.col("_before") + F.col("_copy")).alias(number)] if number else []))
