"""Leave-one-region-out validation."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from segrisk.operators.evaluate import metrics_by_region
from segrisk.operators.features import COPIES, expand_copies, require_columns, with_copies
from segrisk.operators.models import FEATURES, LABEL, PREDICTION, Model
from segrisk.session import materialise, new_path

MIN_ROWS = 10


def region_eligible(df: DataFrame, region: str = "district", min_rows: int = MIN_ROWS) -> DataFrame:
    """Named regions with at least ``min_rows`` rows."""
    require_columns(df, region)
    return (
        with_copies(df)
        .where(F.col(region).isNotNull())
        .groupBy(region)
        .agg(F.sum(COPIES).alias("n_rows"))
        .where(F.col("n_rows") >= min_rows)
    )


def loro_train_sizes(df: DataFrame, region: str = "district", min_rows: int = MIN_ROWS) -> DataFrame:
    """Per eligible region the held-out and the training rows; rows without a region always train."""
    require_columns(df, region)
    counts = with_copies(df).groupBy(region).agg(F.sum(COPIES).alias("n_test"))
    total = counts.agg(F.sum("n_test")).scalar()
    return counts.where(F.col(region).isNotNull() & (F.col("n_test") >= min_rows)).withColumn(
        "n_train", total - F.col("n_test")
    )


def leave_one_region_out(
    table: DataFrame,
    fit: Callable[[DataFrame], Model],
    *,
    region: str = "district",
    min_rows: int = MIN_ROWS,
    parallelism: int = 4,
) -> DataFrame:
    """Predictions for every eligible region by a model fitted on all other rows.

    ``fit`` takes the training rows and returns a model with ``transform``. ``table`` should be a written
    table, since every fold reads it. The loop runs over regions; each fit and each prediction is distributed, and
    predictions are written to the shared folder fold by fold, so the plan of the result does not grow with them.
    """
    spark = table.sparkSession
    names = sorted(r[0] for r in region_eligible(table, region, min_rows).select(region).toLocalIterator())
    if not names:
        return table.where(F.lit(False)).withColumn(PREDICTION, F.lit(None).cast("double"))
    path = new_path(spark, "folds")

    def fold(number: int) -> StructType:
        held_out = F.col(region).eqNullSafe(F.lit(names[number]))
        predicted = fit(table.where(~held_out)).transform(table.where(held_out))
        predicted.write.parquet(f"{path}/fold_{number}")
        return predicted.schema

    with ThreadPool(min(parallelism, len(names))) as pool:
        schemas = pool.map(inheritable_thread_target(spark)(fold), range(len(names)))
    return spark.read.schema(schemas[0]).option("recursiveFileLookup", "true").parquet(path)


def cell_mean_without_region(
    table: DataFrame,
    *,
    region: str = "district",
    features: list[str] = FEATURES,
    label: str = LABEL,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The same as ``leave_one_region_out`` with ``fit_cell_mean``, for all regions at once.

    The training sums of a fold are those of all rows less those of the region, per feature combination and overall.
    A combination without other rows gets the mean of all other rows.
    """
    require_columns(table, region, label, *features)
    sums = [F.sum(F.col(label) * F.col(COPIES)).alias("_own"), F.sum(COPIES).alias("_n")]
    own = with_copies(table).groupBy(region, *features).agg(*sums)
    cells = own.groupBy(*features).agg(F.sum("_own").alias("_all"), F.sum("_n").alias("_n_all"))
    total = own.agg(F.sum("_own").alias("s"), F.sum("_n").alias("n"))
    regions = own.groupBy(region).agg(F.sum("_own").alias("_region"), F.sum("_n").alias("_n_region"))
    regions = regions.where(F.col(region).isNotNull() & (F.col("_n_region") >= min_rows))
    rest = (total.select("s").scalar() - F.col("_region")) / F.nullif(
        total.select("n").scalar() - F.col("_n_region"), F.lit(0)
    )
    seen = (F.col("_all") - F.col("_own")) / F.nullif(F.col("_n_all") - F.col("_n"), F.lit(0))
    predictions = own.join(cells, features).join(regions, region)
    predictions = predictions.select(region, *features, F.coalesce(seen, rest).alias(PREDICTION))
    return table.join(predictions, [region, *features]).select(*table.columns, PREDICTION)


REGION_BLOCK = 512  # regions whose coefficients are fitted together
MAX_ITERATIONS = 60


def poisson_without_region(
    table: DataFrame,
    *,
    region: str = "district",
    features: list[str] = FEATURES,
    label: str = LABEL,
    alpha: float = 1.0,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The same as ``leave_one_region_out`` with ``fit_poisson``, for all regions at once.

    The likelihood of a fold is that of all rows less that of the region, and rows with equal features enter it through
    their number and their sum of labels. So ``table`` is read once, into sums per region and feature combination; each
    step of Newton's method is then one aggregation of those sums, for a block of regions together. The driver holds the
    coefficients and the sums of one block.
    """
    require_columns(table, region, label, *features)
    spark = table.sparkSession
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    names = [f"x{i}" for i in range(len(features))]
    sums = [F.sum(F.col(label) * F.col(COPIES)).cast("double").alias("y"), F.sum(COPIES).cast("double").alias("n")]
    own = materialise(with_copies(table).groupBy(F.col(region).alias("region"), *x).agg(*sums), "region_cells")
    cells = own.groupBy(*names).agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    cells = materialise(cells, "cells")
    eligible = own.groupBy("region").agg(F.sum("n").alias("n"))
    eligible = eligible.where(F.col("region").isNotNull() & (F.col("n") >= min_rows)).select("region")
    spread = cells.agg(*(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in names)).first()
    scale = np.array([1.0, *(spread[c] or 1.0 for c in names)])
    path = new_path(spark, "coefficients")
    regions = sorted(r[0] for r in eligible.toLocalIterator())
    schema = StructType([table.schema[region], *(StructField(f"b{i}", DoubleType()) for i in range(len(scale)))])
    for a in range(0, max(1, len(regions)), REGION_BLOCK):
        names_of_block = regions[a : a + REGION_BLOCK]
        fitted = _newton(own, cells, names_of_block, scale, alpha, schema) if names_of_block else []
        spark.createDataFrame(fitted, schema).coalesce(1).write.parquet(f"{path}/block_{a}")
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    linear = F.col("b0")
    for i, c in enumerate(features, 1):
        linear = linear + F.col(f"b{i}") * F.col(c).cast("double")
    predicted = table.join(found, region).withColumn(PREDICTION, F.exp(linear))
    return predicted.select(*table.columns, PREDICTION)


def _newton(
    own: DataFrame, cells: DataFrame, regions: list, scale: np.ndarray, alpha: float, schema: StructType
) -> list[tuple]:
    """(region, intercept, coefficients) of the fits without each of the regions."""
    spark, size = own.sparkSession, len(scale)
    x = [F.lit(1.0), *(F.col(f"x{i}") / float(scale[i + 1]) for i in range(size - 1))]
    numbers = spark.createDataFrame(
        [(i, r) for i, r in enumerate(regions)],
        StructType([StructField("fold", IntegerType()), StructField("region", schema.fields[0].dataType)]),
    )
    # All rows count for every fold; those of the region itself are taken off again.
    less = own.join(F.broadcast(numbers), "region").drop("region").withColumns({"y": -F.col("y"), "n": -F.col("n")})
    every = cells.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(len(regions) - 1))))
    rows = materialise(every.unionByName(less), "fold_cells")
    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()}
    beta = np.zeros((len(regions), size))
    events = np.array([totals[i]["y"] for i in range(len(regions))])
    weight = np.array([totals[i]["n"] for i in range(len(regions))])
    fit = (events > 0) & (weight > 0)
    # Without any event the optimum is at minus infinity, which predicts 0; without any row there is none.
    beta[:, 0] = np.where(fit, np.log(np.where(fit, events, 1) / np.where(fit, weight, 1)), -np.inf)
    beta[weight <= 0] = np.nan
    penalty = np.diag([0.0, *(alpha / scale[1:] ** 2)])
    moving = fit.copy()
    names = [f"b{i}" for i in range(size)]
    fold_schema = StructType([StructField("fold", IntegerType()), *(StructField(b, DoubleType()) for b in names)])
    for _ in range(MAX_ITERATIONS):
        if not moving.any():
            break
        current = [(int(i), *map(float, beta[i])) for i in np.flatnonzero(moving)]
        mean = F.col("n") * F.exp(sum((F.col(b) * v for b, v in zip(names, x, strict=True)), F.lit(0.0)))
        gradient = [F.sum((mean - F.col("y")) * x[i]).alias(f"g{i}") for i in range(size)]
        hessian = [F.sum(mean * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i + 1)]
        joined = rows.join(F.broadcast(spark.createDataFrame(current, fold_schema)), "fold")
        for row in joined.groupBy("fold").agg(*gradient, *hessian).collect():
            i = row["fold"]
            g = np.array([row[f"g{j}"] for j in range(size)]) / weight[i] + penalty @ beta[i]
            h = np.array([[row[f"h{max(j, k)}_{min(j, k)}"] for k in range(size)] for j in range(size)]) / weight[i]
            step = np.linalg.lstsq(h + penalty, g, rcond=1e-12)[0]
            beta[i] -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))  # no step leaps out of range
            moving[i] = np.abs(step).max() > 1e-11 * max(1.0, np.abs(beta[i]).max())
    with np.errstate(invalid="ignore"):
        raw = np.where(np.isinf(beta[:, :1]) & (np.arange(size) > 0), 0.0, beta / scale)
    return [(region, *map(float, b)) for region, b in zip(regions, raw, strict=True)]


def loro_cell_mean(table: DataFrame, *, region: str = "district", **options) -> DataFrame:
    """Pearson r, R² and RMSE per held-out region of the mean per feature combination."""
    return _scores(cell_mean_without_region(table, region=region, **options), region)


def loro_poisson(table: DataFrame, *, region: str = "district", **options) -> DataFrame:
    """Pearson r, R² and RMSE per held-out region of the Poisson regression."""
    return _scores(poisson_without_region(table, region=region, **options), region)


def loro_metrics(table: DataFrame, fit: Callable[[DataFrame], Model], *, region: str = "district", **options) -> DataFrame:
    """Pearson r, R² and RMSE per held-out region of any model, fitted region by region."""
    return _scores(leave_one_region_out(table, fit, region=region, **options), region)


def _scores(predictions: DataFrame, region: str) -> DataFrame:
    return metrics_by_region(expand_copies(with_copies(predictions), key=region), region)
