"""Crash points, their calendar columns, and the hourly profile."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.functions.calendar import calendar_columns, parse_date, weekday_name


def crash_points(crashes: DataFrame) -> DataFrame:
    """Crashes that have both coordinates (NULL and NaN are missing), with x = longitude, y = latitude."""
    return crashes.dropna(subset=["latitude", "longitude"]).withColumns(
        {"x": F.col("longitude"), "y": F.col("latitude")}
    )


def with_calendar(crashes: DataFrame) -> DataFrame:
    """Crashes whose ``date`` parses, with datetime, hour, weekday, month, year and weekday_name."""
    return (
        crashes.withColumn("datetime", parse_date("date"))
        .dropna(subset=["datetime"])
        .withColumns(calendar_columns("datetime"))
        .withColumn("weekday_name", weekday_name("weekday"))
    )


def crash_datetime(crashes: DataFrame) -> DataFrame:
    """Located crashes with their calendar columns."""
    return with_calendar(crashes.dropna(subset=["latitude", "longitude"]))


def collisions_by_hour(crashes: DataFrame) -> DataFrame:
    """Number of located, dated crashes per hour of day, in the order of the hours."""
    return (
        crash_datetime(crashes).groupBy("hour").agg(F.count(F.lit(1)).alias("n_crashes")).orderBy("hour")
    )


def filter_crashes(
    crashes: DataFrame,
    *,
    hours: tuple[int, int] | None = None,
    weather: Iterable[str] | None = None,
) -> DataFrame:
    """Crashes within an inclusive hour range and with one of the ``weather`` values; use before the spatial join."""
    if hours is not None:
        crashes = with_calendar(crashes).where(F.col("hour").between(*hours))
    if weather is not None:
        crashes = crashes.where(F.col("weather").isin(*weather))
    return crashes
