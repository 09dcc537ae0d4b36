"""GeoJSON in and out.

Two layouts can be read. ``"lines"`` has one feature per text line and is split over tasks; it also takes the
common collection files that put every feature on a line of its own, between a header and a footer line.
``"collection"`` takes any feature collection, one document per file. It is split over tasks as well, but read twice:
first for the state at the start of every block (see ``blocks``), then for the features.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from segrisk.functions.projection import assert_geographic
from segrisk.operators.features import require_columns
from segrisk.schemas import LINES
from segrisk.sources.blocks import scan_objects
from segrisk.sources.tables import id_of

BROKEN_LINE = "not one whole GeoJSON feature in one line, read the file with layout='collection': "
BROKEN = {"lines": BROKEN_LINE, "collection": "not a whole GeoJSON feature: "}

_GEOMETRY = StructType([StructField("type", StringType()), StructField("coordinates", StringType())])
_FEATURE = StructType(
    [
        StructField("type", StringType()),
        StructField("properties", MapType(StringType(), StringType())),
        StructField("geometry", _GEOMETRY),
    ]
)


def _property(name: str) -> Column:
    """Text of a property, whatever the case of its name."""
    same = F.filter(F.map_entries("properties"), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(same, F.lit(0))["value"]


def _typed(field: StructField) -> Column:
    """The property as its declared type; text that cannot be converted raises."""
    text = _property(field.name)
    value = id_of(text) if isinstance(field.dataType, LongType) else text.cast(field.dataType)
    return value.alias(field.name)


def _require_properties(features: DataFrame, properties: StructType) -> None:
    """Fail if a declared property is in no feature at all. Usually the first features answer that."""
    if features.isEmpty():
        return
    for name in properties.names:
        keys = F.transform(F.map_keys("properties"), F.lower)
        if features.where(F.array_contains(keys, name.lower())).isEmpty():
            raise ValueError(f"no feature has the property {name!r}")


def scan_features(spark: SparkSession, path: str, properties: StructType, layout: str = "lines") -> DataFrame:
    """Feature rows: ``properties`` as a struct of the given type, ``geometry`` with its coordinates as text.

    Property names match in any case. Whole numbers are read from 12, 12.0 and "12" alike.
    """
    features = _features(spark, path, layout)
    _require_properties(features, properties)
    return features.select(F.struct(*(_typed(f) for f in properties)).alias("properties"), "geometry")


def _features(spark: SparkSession, path: str, layout: str) -> DataFrame:
    if layout == "lines":
        rows = spark.read.text(path).select(F.rtrim(F.regexp_replace(F.trim("value"), r",\s*$", "")).alias("value"))
    elif layout == "collection":
        rows = scan_objects(spark, path).select(F.col("text").alias("value"))
    else:
        raise ValueError(f"layout must be 'lines' or 'collection', got {layout!r}")
    parsed = rows.select("value", F.from_json("value", _FEATURE).alias("f"))
    # Header and footer lines mention no feature; anything else that is not one must not be lost silently.
    broken = F.raise_error(F.concat(F.lit(BROKEN[layout]), F.substring("value", 1, 200))).cast("boolean")
    is_feature = F.coalesce(F.col("f.type") == "Feature", F.lit(False))
    kept = F.when(is_feature, F.lit(True)).when(F.contains("value", F.lit('"Feature"')), broken)
    return parsed.where(kept.otherwise(F.lit(False))).select("f.*")


def _coordinates(kind: str, ddl: str) -> Column:
    """Coordinates of geometries of one type, NULL for all others."""
    geometry = F.col("geometry")
    return F.when(geometry["type"] == kind, F.from_json(geometry["coordinates"], ddl))


def _checked(value: Column, valid: Column, *kinds: str) -> Column:
    """NULL without a geometry, ``value`` of a valid geometry of one of the kinds; any other geometry raises."""
    kind = F.col("geometry.type")
    shown = F.concat_ws(" ", F.lit("cannot read this geometry:"), kind, F.substring("geometry.coordinates", 1, 200))
    good = kind.isin(*kinds) & F.coalesce(valid, F.lit(False))
    return F.when(kind.isNull(), F.lit(None)).when(good, value).otherwise(F.raise_error(shown))


def _is_position(position: Column) -> Column:
    x, y = F.get(position, F.lit(0)), F.get(position, F.lit(1))
    return x.isNotNull() & y.isNotNull()


def scan_geojson_points(
    spark: SparkSession,
    path: str,
    properties: StructType,
    layout: str = "lines",
    crs: str | None = None,
) -> DataFrame:
    """Point features as their properties plus longitude and latitude (NULL without a geometry).

    A MultiPoint of one position is that point; other geometries, and coordinates that are no numbers, raise.
    """
    assert_geographic(crs)
    several = _coordinates("MultiPoint", "array<array<double>>")
    only = F.when(F.size(several) == 1, F.get(several, F.lit(0)))
    found = F.coalesce(_coordinates("Point", "array<double>"), only)
    return (
        scan_features(spark, path, properties, layout)
        .withColumn("_found", found)
        .withColumn("_point", _checked(F.col("_found"), _is_position(F.col("_found")), "Point", "MultiPoint"))
        .select("properties.*", F.get("_point", 0).alias("longitude"), F.get("_point", 1).alias("latitude"))
    )


def scan_geojson_lines(
    spark: SparkSession,
    path: str,
    properties: StructType,
    layout: str = "lines",
    crs: str | None = None,
) -> DataFrame:
    """Line features as their properties plus ``lines``: one part for a LineString, NULL without a geometry.

    Other geometries, and coordinates that are no numbers, raise.
    """
    assert_geographic(crs)
    single = F.array(_coordinates("LineString", "array<array<double>>"))
    several = _coordinates("MultiLineString", "array<array<array<double>>>")
    found = F.when(F.col("geometry.type") == "LineString", single).otherwise(several)
    valid = F.forall("_found", lambda line: line.isNotNull() & F.forall(line, _is_position))

    def vertex(position: Column) -> Column:
        return F.struct(F.get(position, F.lit(0)).alias("x"), F.get(position, F.lit(1)).alias("y"))

    lines = F.transform("_positions", lambda line: F.transform(line, vertex)).cast(LINES)
    return (
        scan_features(spark, path, properties, layout)
        .withColumn("_found", found)
        .withColumn("_positions", _checked(F.col("_found"), valid, "LineString", "MultiLineString"))
        .select("properties.*", lines.alias("lines"))
    )


def feature_text(df: DataFrame, lines: str = "lines") -> Column:
    """One GeoJSON feature per row: every other column is a property, missing numbers and geometries are null."""

    def property_column(name: str, kind: str) -> Column:
        value = F.col(name)
        return (F.nanvl(value, F.lit(None)) if kind in ("double", "float") else value).alias(name)

    keep_null = {"ignoreNullFields": "false"}
    properties = F.struct(*(property_column(n, t) for n, t in df.dtypes if n != lines))
    coordinates = F.transform(lines, lambda line: F.transform(line, lambda v: F.array(v["x"], v["y"])))
    geometry = (
        F.when(F.col(lines).isNull(), F.lit("null"))
        .when(
            F.size(lines) == 1,
            F.to_json(
                F.struct(F.lit("LineString").alias("type"), F.get(coordinates, F.lit(0)).alias("coordinates"))
            ),
        )
        .otherwise(
            F.to_json(F.struct(F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates")))
        )
    )
    return F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(properties, keep_null),
        F.lit(',"geometry":'),
        geometry,
        F.lit("}"),
    )


def export_geojson(df: DataFrame, path: str, columns: Iterable[str] | None = None, mode: str = "error") -> None:
    """Write newline-delimited features, one file per partition, readable with ``layout="lines"``."""
    require_columns(df, "lines")
    chosen = df if columns is None else df.select(*columns, "lines")
    chosen.select(feature_text(chosen).alias("value")).write.mode(mode).text(path)
