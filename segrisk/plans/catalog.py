"""The named queries: every operator applied to the whole derived tables of a benchmark folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from segrisk.functions.projection import with_utm
from segrisk.operators import evaluate, forest, models, regions, spatial_join, split, temporal
from segrisk.operators.features import expand_copies
from segrisk.operators.features import segment_features as features_of
from segrisk.plans.fixtures import fixture_dataset
from segrisk.plans.pipeline import model_table, risk_table, segment_rows, segment_table
from segrisk.session import new_path
from segrisk.sources import bundle, geojson, tables

Query = Callable[[SparkSession, str], DataFrame]

ROW_COLUMNS = ["ogf_id", "district", "speed_limit", "number_of_lanes", "road_class", "high_speed"]
DAYTIME = (6, 18)
WEATHER = ("click", "view")
ZONE_SHIFT = 1.39  # degrees that put the border of zones 17 and 18 into the middle of the network


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Sources and sinks: the derived tables are written to the shared folder and read back.


def _as_csv(df: DataFrame, name: str, sep: str) -> str:
    path = new_path(df.sparkSession, name)
    df.toDF(*(c.upper() for c in df.columns)).write.csv(path, sep=sep, header=True)
    return path


def _upper(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: n.upper() for n in names})


def scan_attribute_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_speed(spark, _as_csv(fixture_dataset(spark, sf_dir).speed, "speed_csv", ";"))


def scan_road_class_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_road_class(spark, _as_csv(fixture_dataset(spark, sf_dir).road_class, "class_csv", ";"))


def scan_crash_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_csv(fixture_dataset(spark, sf_dir).crashes, "crash_csv", ",")
    return tables.scan_crash_csv(spark, path).withColumn("crash_id", F.col("crash_id").cast("bigint"))


COLLECTIONS = 3  # files that one-document collections are written to


def _point_feature(names: list[str]) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*names).alias("properties"),
        F.when(F.col("longitude").isNotNull(), point).alias("geometry"),
    )
    return F.to_json(feature, {"ignoreNullFields": "false"})


def _as_point_features(crashes: DataFrame, names: list[str], path: str) -> str:
    crashes.select(_point_feature(names)).write.text(path)
    return path


def scan_geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["crash_id", "date", "weather", "district"]
    path = _as_point_features(fixture_dataset(spark, sf_dir).crashes, names, new_path(spark, "points_geojson"))
    types = [LongType(), StringType(), StringType(), StringType()]
    properties = StructType([StructField(n, t) for n, t in zip(names, types, strict=True)])
    return geojson.scan_geojson_points(spark, path, properties)


def scan_geojson_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crashes as collections, each one JSON document without line breaks, cut at any byte when they are read."""
    path = new_path(spark, "collections")
    names = ["crash_id", "date", "weather", "district"]
    crashes = fixture_dataset(spark, sf_dir).crashes
    features = crashes.select(
        (F.col("crash_id") % COLLECTIONS).cast("int").alias("file"),
        F.lit(1).alias("place"),
        F.concat(F.lit(","), _point_feature(names)).alias("value"),
    )
    heads = '{"type":"FeatureCollection","crs":{"type":"name"},"features":[{"type":"none","why":"first {\\"} of all"}'
    ends = (
        spark.range(COLLECTIONS)
        .select(F.col("id").cast("int").alias("file"), F.explode(F.array(F.lit(0), F.lit(2))).alias("place"))
        .withColumn("value", F.when(F.col("place") == 0, F.lit(heads)).otherwise(F.lit("]}")))
    )
    rows = features.unionByName(ends).repartition("file").sortWithinPartitions("file", "place")
    rows.drop("place").write.partitionBy("file").text(path, lineSep=" ")
    types = [LongType(), StringType(), StringType(), StringType()]
    properties = StructType([StructField(n, t) for n, t in zip(names, types, strict=True)])
    return geojson.scan_geojson_points(spark, path, properties, layout="collection")


def scan_crash_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crashes whose weather has two lines."""
    crashes = fixture_dataset(spark, sf_dir).crashes
    crashes = crashes.withColumn("weather", F.concat("weather", F.lit('\n"in" '), "district"))
    path = new_path(spark, "quoted_csv")
    crashes.toDF(*(c.upper() for c in crashes.columns)).write.csv(path, header=True, escape='"')
    found = tables.scan_crash_csv(spark, path, multi_line=True)
    return found.withColumn("crash_id", F.col("crash_id").cast("bigint"))


def scan_geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "roads_geojson")
    geojson.export_geojson(_upper(fixture_dataset(spark, sf_dir).roads, "ogf_id", "district"), path)
    roads = geojson.scan_geojson_lines(spark, path, bundle.ROAD_PROPERTIES)
    parts = roads.select("ogf_id", "district", F.posexplode("lines").alias("part", "line"))
    return parts.select("ogf_id", "district", "part", F.posexplode("line").alias("vertex", "v")).select(
        "ogf_id", "district", "part", "vertex", "v.x", "v.y"
    )


def load_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to counts: all five inputs are written as files, loaded, joined and counted."""
    d = fixture_dataset(spark, sf_dir)
    roads = new_path(spark, "roads_geojson")
    geojson.export_geojson(_upper(d.roads, "ogf_id", "district"), roads)
    attributes = {"speed": d.speed, "lanes": d.lanes, "road_class": d.road_class}
    paths = {name: _as_csv(df, f"{name}_csv", ";") for name, df in attributes.items()}
    loaded = bundle.load_dataset(spark, roads=roads, crashes=_as_csv(d.crashes, "crash_csv", ","), **paths)
    rows = segment_rows(loaded)
    return rows.select("ogf_id", "speed_limit", "number_of_lanes", "road_class", "crash_count")


def load_dataset_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other formats of the bundle: segments from Parquet, crashes from GeoJSON."""
    d = fixture_dataset(spark, sf_dir)
    roads = new_path(spark, "roads.parquet")
    _upper(d.roads, "ogf_id", "district").write.parquet(roads)
    crashes = _as_point_features(_upper(d.crashes, "date"), ["DATE"], new_path(spark, "crashes.geojson"))
    attributes = {"speed": d.speed, "lanes": d.lanes, "road_class": d.road_class}
    paths = {name: _as_csv(df, f"{name}_csv", ";") for name, df in attributes.items()}
    loaded = bundle.load_dataset(spark, roads=roads, crashes=crashes, **paths)
    rows = segment_rows(loaded, mode="segments")
    return rows.select("ogf_id", "speed_limit", "number_of_lanes", "road_class", "crash_count")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.dataset_profile(fixture_dataset(spark, sf_dir))


EXPORTED = StructType(
    [
        StructField("ogf_id", LongType()),
        StructField("district", StringType()),
        StructField("speed_limit", DoubleType()),
        StructField("number_of_lanes", IntegerType()),
        StructField("road_class", StringType()),
        StructField("high_speed", BooleanType()),
        StructField("crash_count", LongType()),
    ]
)


def _read_back(df: DataFrame) -> DataFrame:
    return df.select(*ROW_COLUMNS, "crash_count", F.size(F.get("lines", F.lit(0))).alias("n_vertices"))


def export_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "segments_geojson")
    geojson.export_geojson(segment_rows(fixture_dataset(spark, sf_dir)), path)
    return _read_back(geojson.scan_geojson_lines(spark, path, EXPORTED))


def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "segments_parquet")
    bundle.export_parquet(segment_rows(fixture_dataset(spark, sf_dir)), path)
    return _read_back(spark.read.parquet(path))


# Features and crashes in time.


def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    return expand_copies(features_of(d.roads.drop("lines"), d.speed, d.lanes, d.road_class)).select(*ROW_COLUMNS)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_rows(fixture_dataset(spark, sf_dir))
    return models.feature_matrix(rows).select("ogf_id", *models.FEATURES, models.LABEL)


def crash_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.crash_points(fixture_dataset(spark, sf_dir).crashes).select("crash_id", "x", "y")


def crash_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["crash_id", "date", "datetime", "hour", "weekday", "month", "year", "weekday_name"]
    return temporal.crash_datetime(fixture_dataset(spark, sf_dir).crashes).select(*columns)


def collisions_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.collisions_by_hour(fixture_dataset(spark, sf_dir).crashes)


# Spatial operators.


def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    crashes = spatial_join.located_crashes(fixture_dataset(spark, sf_dir).crashes)
    projected = with_utm(crashes, ("longitude", "latitude", "x", "y"))
    return _rounded(projected.select("crash_id", "x", "y"), "x", "y", digits=3)


def spatial_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    return spatial_join.spatial_join_pairs(d.crashes, d.roads)


def unmatched_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    return spatial_join.unmatched_crashes(d.crashes, d.roads).select("crash_id", "longitude", "latitude")


def _counted(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = segment_rows(fixture_dataset(spark, sf_dir), mode=mode)
    return rows.select("ogf_id", "speed_limit", "number_of_lanes", "road_class", "crash_count")


def crash_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "rows")


def crash_count_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "segments")


def crash_count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    crashes = temporal.filter_crashes(d.crashes, hours=DAYTIME, weather=WEATHER)
    return spatial_join.crash_counts(d.roads, crashes, mode="segments")


def crash_counts_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    return spatial_join.crash_counts_cube(d.roads, temporal.crash_datetime(d.crashes))


def spatial_join_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same network moved onto the border of two zones, at 78 degrees west."""
    d = fixture_dataset(spark, sf_dir)
    east = F.lit(ZONE_SHIFT)
    moved = F.transform("lines", lambda line: F.transform(line, lambda v: v.withField("x", v["x"] + east)))
    roads = d.roads.withColumn("lines", moved)
    crashes = d.crashes.withColumn("longitude", F.col("longitude") + east)
    return spatial_join.spatial_join_pairs(crashes, roads, zone=None)


def segments_with_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = spatial_join.segments_with_crashes(segment_table(fixture_dataset(spark, sf_dir)))
    return expand_copies(hit).select("ogf_id", "crash_count")


def segments_with_crashes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join.segments_with_crashes_total(segment_table(fixture_dataset(spark, sf_dir)))


def top_crash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture_dataset(spark, sf_dir)
    return spatial_join.top_crash_segments(spatial_join.crash_counts(d.roads, d.crashes, mode="segments"))


# Models. The model table is written once per query and read by every fit.


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.holdout_split(fixture_dataset(spark, sf_dir).roads).select("ogf_id", "is_test")


def _train_test(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Training rows with their ``copies``, and test rows written out."""
    table = model_table(fixture_dataset(spark, sf_dir), keep=("ogf_id", "district", *more))
    train, test = split.train_test(table)
    return train, expand_copies(test)


def _cell_mean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return models.fit_cell_mean(train).transform(test)


def rf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return models.fit_random_forest(train).transform(test)


def tree_cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _train_test(spark, sf_dir)
    fitted = models.fit_tree(train).transform(expand_copies(train))
    return _rounded(fitted.select("ogf_id", *models.FEATURES, "prediction"), "prediction")


def rf_hash_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return _rounded(forest.fit_hash_forest(train).transform(test), "prediction")


def rf_hash_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir, "road_class")
    features = ["speed_limit", "number_of_lanes", "road_class", "high_speed"]
    return _rounded(forest.fit_hash_forest(train, features=features).transform(test), "prediction")


def poisson_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return models.fit_poisson(train).transform(test)


def poisson_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _train_test(spark, sf_dir)
    fitted = models.fit_poisson(train, features=["high_speed"], alpha=0.0).transform(expand_copies(train))
    return _rounded(fitted.select("ogf_id", "high_speed", "prediction"), "prediction")


def rf_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir, "road_class")
    return models.fit_road_class_forest(train).transform(test)


def tree_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _train_test(spark, sf_dir, "road_class")
    fitted = models.fit_road_class_forest(train, trees=1, bootstrap=False).transform(expand_copies(train))
    return _rounded(fitted.select("ogf_id", "road_class", *models.FEATURES, "prediction"), "prediction")


def poisson_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _train_test(spark, sf_dir)
    fitted = models.fit_poisson(train, features=["high_speed"], alpha=1.0).transform(expand_copies(train))
    return _rounded(fitted.select("ogf_id", "high_speed", "prediction"), "prediction")


def risk_cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = risk_table(fixture_dataset(spark, sf_dir), models.fit_cell_mean)
    return _rounded(scored.select(*ROW_COLUMNS, "crash_count", "predicted_risk"), "predicted_risk")


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = risk_table(fixture_dataset(spark, sf_dir), forest.fit_hash_forest)
    return _rounded(scored.select(*ROW_COLUMNS, "crash_count", "predicted_risk"), "predicted_risk")


# Evaluation, on the closed-form predictor that SQL can repeat.


def residuals_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    residuals = evaluate.with_residual(_cell_mean_predictions(spark, sf_dir))
    return _rounded(
        residuals.select("ogf_id", "crash_count", "prediction", "residual"), "prediction", "residual"
    )


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.regression_metrics(_cell_mean_predictions(spark, sf_dir)), "r2", "rmse")


def metrics_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _cell_mean_predictions(spark, sf_dir).where(F.col("district").isNotNull())
    return _rounded(evaluate.metrics_by_region(named), "pearson_r", "r2", "rmse")


def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    residuals = evaluate.with_residual(_cell_mean_predictions(spark, sf_dir))
    return _rounded(evaluate.residual_histogram(residuals), "lower", "upper")


def pred_vs_actual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pred_vs_actual_summary(_cell_mean_predictions(spark, sf_dir), digits=6)


# Regions.


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions need no crashes, and no row written out per copy."""
    d = fixture_dataset(spark, sf_dir)
    return features_of(d.roads.drop("lines"), d.speed, d.lanes, d.road_class)


def region_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_eligible(_feature_rows(spark, sf_dir))


def loro_train_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.loro_train_sizes(_feature_rows(spark, sf_dir))


def loro_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = model_table(fixture_dataset(spark, sf_dir))
    scores = regions.loro_poisson(table, features=["high_speed"], alpha=0.0)
    return _rounded(scores, "pearson_r", "r2", "rmse")


def loro_cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = regions.loro_cell_mean(model_table(fixture_dataset(spark, sf_dir)))
    return _rounded(scores, "pearson_r", "r2", "rmse")


def loro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = forest.loro_forest(model_table(fixture_dataset(spark, sf_dir)))
    return _rounded(scores, "pearson_r", "r2", "rmse")


def queries() -> dict[str, Query]:
    functions = [
        scan_attribute_csv, scan_road_class_csv, scan_crash_csv, scan_crash_csv_quoted,
        scan_geojson_points, scan_geojson_lines, scan_geojson_collection,
        load_dataset_counts, load_dataset_formats, dataset_profile, export_geojson, export_parquet,
        segment_features, feature_matrix, crash_points, crash_datetime, collisions_by_hour,
        project_points, spatial_join_pairs, unmatched_crashes,
        spatial_join_zones, crash_count_rows, crash_count_segments, crash_count_filtered, crash_counts_cube,
        segments_with_crashes, segments_with_crashes_total, top_crash_segments,
        holdout_split, rf_predictions, rf_hash_bootstrap, rf_hash_road_class, tree_cell_mean, poisson_predictions, poisson_group_mean,
        poisson_penalised, rf_road_class, tree_road_class, risk_cell_mean, risk_scores,
        residuals_by_segment, regression_metrics, metrics_by_region, residual_histogram, pred_vs_actual_summary,
        region_eligible, loro_train_sizes, loro_cell_mean, loro_poisson, loro_metrics,
    ]
    return {f.__name__: f for f in functions}
