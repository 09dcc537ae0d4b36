"""Delimited text tables, selected by column name and cast to explicit types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segrisk.operators.features import require_columns
from segrisk.schemas import ELEMENT_ID, NUMBER_OF_LANES, ROAD_CLASS, SPEED_LIMIT
from segrisk.sources.blocks import scan_quoted_lines

# Text that stands for a missing value in delimited files.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _text(name: str) -> Column:
    return F.when(~F.col(name).isin(MISSING), F.col(name))


def id_of(text: Column) -> Column:
    """BIGINT from text: whole numbers, also written as 12.0; missing stays missing, anything else raises."""
    text = F.trim(text)
    whole = F.regexp_extract(text, r"^([+-]?\d+)(?:\.0*)?$", 1)
    wrong = F.raise_error(F.concat(F.lit("not a whole number as id: "), text)).cast("bigint")
    return F.when(text.isNull(), F.lit(None).cast("bigint")).when(whole != "", whole.cast("bigint")).otherwise(wrong)


def _read(spark: SparkSession, path: str, sep: str, multi_line: bool = False) -> DataFrame:
    """All columns as text under lower-case names. Only the columns used later are parsed.

    A file of the folder whose header differs from the first one's raises, because columns go by position.
    """
    options = {"sep": sep, "header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.csv(path, inferSchema=False, **options).schema
    if multi_line:
        df = _read_quoted(spark, path, header, sep)
    else:
        df = spark.read.schema(header).csv(path, enforceSchema=False, **options)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def _read_quoted(spark: SparkSession, path: str, header: StructType, sep: str) -> DataFrame:
    """Rows whose quoted values may hold line breaks. Rows that repeat the header are headers."""
    text = F.regexp_replace("text", r"\r?\n$", "")
    rows = scan_quoted_lines(spark, path).select(text.alias("text")).where("text <> ''")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    by_place = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = rows.select(F.from_csv("text", by_place, options).alias("r"))
    same = [F.col(f"r.c{i}").eqNullSafe(F.lit(name)) for i, name in enumerate(header.names)]
    return parsed.where(~reduce(Column.__and__, same)).select("r.*").toDF(*header.names)


def scan_attribute_csv(
    spark: SparkSession, path: str, value: str, value_type: str = "double", sep: str = ";"
) -> DataFrame:
    """An attribute table as (orn_road_net_element_id BIGINT, ``value``). Text that is no number raises."""
    df = _read(spark, path, sep)
    require_columns(df, ELEMENT_ID, value)
    return df.select(id_of(_text(ELEMENT_ID)).alias(ELEMENT_ID), _text(value).cast(value_type).alias(value))


def scan_speed(spark: SparkSession, path: str) -> DataFrame:
    return scan_attribute_csv(spark, path, SPEED_LIMIT)


def scan_lanes(spark: SparkSession, path: str) -> DataFrame:
    return scan_attribute_csv(spark, path, NUMBER_OF_LANES)


def scan_road_class(spark: SparkSession, path: str) -> DataFrame:
    return scan_attribute_csv(spark, path, ROAD_CLASS, "string")


def scan_crash_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Crashes: latitude and longitude as DOUBLE, date and all other columns as text.

    ``multi_line`` allows line breaks inside quoted values, which otherwise raise. Files are split over tasks either
    way; with it they are read twice, first for the quotes before each block (see ``blocks``).
    """
    df = _read(spark, path, sep, multi_line)
    require_columns(df, "latitude", "longitude", "date")
    numbers = {"latitude", "longitude"}
    return df.select(
        *(_text(c).cast("double").alias(c) if c in numbers else _text(c).alias(c) for c in df.columns)
    )
