"""The five inputs of the pipeline as one object, and their profile."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, NullType, StringType, StructField, StructType

from segrisk.operators.features import require_columns
from segrisk.schemas import ROADS
from segrisk.sources.geojson import scan_geojson_lines, scan_geojson_points
from segrisk.sources.tables import scan_crash_csv, scan_lanes, scan_road_class, scan_speed


@dataclass(frozen=True)
class Dataset:
    """Lazy inputs: segments, three attribute tables and crashes."""

    roads: DataFrame
    speed: DataFrame
    lanes: DataFrame
    road_class: DataFrame
    crashes: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


ROAD_PROPERTIES = StructType([StructField("ogf_id", LongType()), StructField("district", StringType())])
CRASH_PROPERTIES = StructType([StructField("date", StringType())])


def load_dataset(
    spark: SparkSession,
    *,
    roads: str,
    speed: str,
    lanes: str,
    road_class: str,
    crashes: str,
    road_properties: StructType = ROAD_PROPERTIES,
    crash_properties: StructType = CRASH_PROPERTIES,
    layout: str = "lines",
) -> Dataset:
    """Scan the inputs from their paths.

    ``roads`` is GeoJSON, or Parquet when the path ends in ``.parquet``, with columns as ``schemas.ROADS`` in WGS 84.
    ``crashes`` is GeoJSON when its path ends in ``.geojson`` or ``.json``, with ``crash_properties``; else CSV.
    """
    if roads.rstrip("/").endswith(".parquet"):
        segments = scan_parquet_roads(spark, roads)
    else:
        segments = scan_geojson_lines(spark, roads, road_properties, layout)
    if crashes.rstrip("/").endswith((".geojson", ".json")):
        located = scan_geojson_points(spark, crashes, crash_properties, layout)
    else:
        located = scan_crash_csv(spark, crashes)
    return Dataset(
        roads=segments,
        speed=scan_speed(spark, speed),
        lanes=scan_lanes(spark, lanes),
        road_class=scan_road_class(spark, road_class),
        crashes=located,
    )


def scan_parquet_roads(spark: SparkSession, path: str) -> DataFrame:
    """Segments from Parquet: id, lines and region are required and cast to their types, other columns stay."""
    df = spark.read.parquet(path)
    require_columns(df, *(f.name for f in ROADS))
    names = {c.lower(): c for c in df.columns}
    for field in ROADS:
        kind = df.schema[names[field.name]].dataType
        fits = kind == field.dataType if field.name == "lines" else isinstance(kind, _ACCEPTED[field.name])
        if not fits:
            raise ValueError(f"column {field.name!r} is {kind.simpleString()}, not {field.dataType.simpleString()}")
    own = [F.col(names[f.name]).cast(f.dataType).alias(f.name) for f in ROADS]
    rest = [c for c in df.columns if c.lower() not in ROADS.names]
    return df.select(*own, *rest)


_ACCEPTED = {"ogf_id": IntegralType, "district": (StringType, NullType)}


def dataset_profile(dataset: Dataset) -> DataFrame:
    """Per input table its name, number of rows and comma-separated column names."""
    profiles = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(",".join(df.columns)).alias("column_names")
        )
        for name, df in dataset.tables().items()
    ]
    return reduce(DataFrame.unionByName, profiles)


def export_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """The segment table, geometry included, as Parquet."""
    df.write.mode(mode).parquet(path)
