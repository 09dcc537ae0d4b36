from datetime import datetime

from pyspark.sql import functions as F

from segrisk.functions.calendar import parse_date, weekday_name
from segrisk.operators.temporal import collisions_by_hour, crash_datetime, crash_points, filter_crashes

GOOD = {
    "01/02/2020 12:00:00 AM": datetime(2020, 1, 2, 0, 0),
    "1/2/2020 3:04:05 PM": datetime(2020, 1, 2, 15, 4, 5),
    "01/02/2020 03:04:05 pm": datetime(2020, 1, 2, 15, 4, 5),
    "12/31/1999 12:59:59 PM": datetime(1999, 12, 31, 12, 59, 59),
}
BAD = [
    "2020-01-02", "13/02/2020 01:00:00 AM", "02/30/2020 01:00:00 AM", "01/02/2020 13:00:00 PM",
    "1/2/20 3:04:05 PM", "", "01/02/2020 03:04:05 PM ", None,
]


def crashes(spark):
    rows = [(i, 43.0, -79.0, d, "Rain" if i % 2 else "Clear") for i, d in enumerate([*GOOD, *BAD])]
    rows += [(50, None, -79.0, "01/02/2020 12:00:00 AM", "Rain"), (51, 43.0, float("nan"), "x", "Rain")]
    return spark.createDataFrame(
        rows, "crash_id long, latitude double, longitude double, date string, weather string"
    )


def test_parse(spark):
    dates = [*GOOD, *BAD]
    df = spark.createDataFrame([(d,) for d in dates], "date string").withColumn("t", parse_date("date"))
    assert dict(df.dtypes)["t"] == "timestamp_ntz"
    assert [r.t for r in df.collect()] == [GOOD.get(d) for d in dates]


def test_calendar_columns(spark):
    rows = {r.crash_id: r for r in crash_datetime(crashes(spark)).collect()}
    assert set(rows) == {0, 1, 2, 3}
    r = rows[1]
    assert (r.hour, r.weekday, r.month, r.year, r.weekday_name) == (15, 3, 1, 2020, "Thu")
    names = spark.range(9).select(weekday_name("id").alias("n")).collect()
    assert [r.n for r in names] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", None, None]


def test_points_profile_and_filter(spark):
    df = crashes(spark)
    assert crash_points(df).count() == 12
    assert [tuple(r) for r in collisions_by_hour(df).collect()] == [(0, 1), (12, 1), (15, 2)]
    assert {r.crash_id for r in filter_crashes(df, hours=(12, 15), weather=["Rain"]).collect()} == {1, 3}
    assert filter_crashes(df, weather=["Rain"]).where(F.col("crash_id") == 51).count() == 1
    assert filter_crashes(df) is df
