"""Scores, residuals and the tables behind the diagnostic plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrisk.operators.models import LABEL, PREDICTION


def _null_if_zero(column: Column) -> Column:
    return F.nullif(column, F.lit(0.0))


def _scores(label: str) -> dict[str, Column]:
    """Aggregates over (label, prediction); all are NULL, not an error, where they are undefined."""
    y, p = F.col(label).cast("double"), F.col(PREDICTION)
    squared = F.pow(y - p, 2)
    return {
        "n_rows": F.count(F.lit(1)),
        "r2": 1 - F.sum(squared) / _null_if_zero(F.var_pop(y) * F.count(y)),
        "rmse": F.sqrt(F.avg(squared)),
        # The product form, because corr() divides by zero under ANSI when a side is constant.
        "pearson_r": F.covar_pop(y, p) / _null_if_zero(F.stddev_pop(y) * F.stddev_pop(p)),
    }


def regression_metrics(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: n_rows, r2 and rmse."""
    scores = _scores(label)
    return predictions.agg(*(scores[name].alias(name) for name in ("n_rows", "r2", "rmse")))


def metrics_by_region(predictions: DataFrame, region: str = "district", label: str = LABEL) -> DataFrame:
    """Per region: n_rows, pearson_r, r2 and rmse."""
    scores = _scores(label)
    return predictions.groupBy(region).agg(*(column.alias(name) for name, column in scores.items()))


def with_residual(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """Actual minus predicted, on the keyed row itself."""
    return predictions.withColumn("residual", F.col(label) - F.col(PREDICTION))


def residual_histogram(residuals: DataFrame, column: str = "residual", bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over the value range: bin, lower, upper, n. The last bin is closed.

    The index from the division is corrected by one step against the edges, because rounding can put a value on
    the wrong side of an edge. A constant column gets the range value - 0.5 .. value + 0.5.
    """
    values = residuals.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = values.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    margin = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select(
        F.struct((F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi")).alias("ends")
    ).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / bins))

    guess = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    g = F.col("_bin")
    corrected = (
        F.when(F.col("_v") < edge(g), g - 1)
        .when((g < bins - 1) & (F.col("_v") >= edge(g + 1)), g + 1)
        .otherwise(g)
    )
    counts = (
        values.withColumns({"_lo": lo, "_hi": hi})
        .withColumn("_bin", guess)
        .select(corrected.alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    i = F.col("bin")
    return (
        residuals.sparkSession.range(bins)
        .select(F.col("id").alias("bin"))
        .join(counts, "bin", "left")
        .withColumns({"_lo": lo, "_hi": hi})
        .select(
            i.cast("int").alias("bin"),
            edge(i).alias("lower"),
            edge(i + 1).alias("upper"),
            F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"),
        )
    )


def pred_vs_actual_summary(predictions: DataFrame, label: str = LABEL, digits: int = 2) -> DataFrame:
    """The scatter of predicted against actual as counts, with the label range for its identity line."""
    pairs = predictions.groupBy(label, F.round(PREDICTION, digits).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ends = predictions.agg(F.struct(F.min(label).alias("lo"), F.max(label).alias("hi")).alias("ends")).scalar()
    return pairs.withColumns({"label_min": ends.getField("lo"), "label_max": ends.getField("hi")})
