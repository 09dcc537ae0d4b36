import pytest
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from segrisk.functions.missing import zero_filled
from segrisk.operators.features import (
    attach_attributes,
    drop_prefixed,
    expand_copies,
    require_columns,
    segment_features,
)

KEY = "orn_road_net_element_id"


@pytest.fixture(scope="module")
def inputs(spark):
    nan = float("nan")
    roads = spark.createDataFrame([(i, "A") for i in range(1, 6)] + [(None, "B")], "ogf_id long, district string")
    speed = spark.createDataFrame(
        [(1, 60.0), (1, 60.0), (1, 40.0), (2, None), (3, nan), (4, 50.0), (None, 90.0), (99, 90.0)],
        f"{KEY} long, speed_limit double",
    )
    lanes = spark.createDataFrame([(1, 2.9), (1, 2.9), (2, None), (4, -2.9)], f"{KEY} long, number_of_lanes double")
    classes = spark.createDataFrame([(1, "Local"), (1, "Ramp"), (5, "Local")], f"{KEY} long, road_class string")
    return roads, speed, lanes, classes


def test_features_and_fan_out(inputs):
    rows = expand_copies(segment_features(*inputs), block=3).collect()
    assert rows[0].asDict().keys() == {
        "ogf_id", "district", "speed_limit", "number_of_lanes", "road_class", "high_speed",
    }
    # Element 1: three speed rows, two lane rows, two classes.
    one = [r for r in rows if r.ogf_id == 1]
    assert len(one) == 12 and len(rows) == 17
    assert sum(r.high_speed for r in one) == 8 and {r.number_of_lanes for r in one} == {2}
    assert {r.road_class for r in one} == {"Local", "Ramp"}
    flags = {r.ogf_id: (r.high_speed, r.number_of_lanes) for r in rows if r.ogf_id != 1}
    assert flags == {2: (False, 1), 3: (False, 1), 4: (False, -2), 5: (False, 1), None: (False, 1)}


def test_copies_replace_repeated_rows(inputs):
    weighted = segment_features(*inputs)
    assert weighted.count() == 9
    assert weighted.agg(F.sum("copies")).first()[0] == 17


def test_expand_copies_in_blocks(spark):
    df = spark.createDataFrame([(1, 1), (2, 7), (3, 10), (None, 25)], "ogf_id long, copies long")
    expected = {1: 1, 2: 7, 3: 10, None: 25}
    for block in (1, 4, 5, 1000):
        counted = expand_copies(df, block=block).groupBy("ogf_id").count().collect()
        assert {r.ogf_id: r["count"] for r in counted} == expected


def test_deduplication_is_optional(spark, inputs):
    roads, speed, lanes, classes = inputs
    one = F.col("ogf_id") == 1
    largest = attach_attributes(roads, speed, lanes, classes, dedup="max").where(one).collect()
    assert [(r.speed_limit, r.number_of_lanes, r.road_class, r.copies) for r in largest] == [(60.0, 2.9, "Ramp", 1)]
    dated = [t.withColumn("seq", F.monotonically_increasing_id()) for t in (lanes, classes)]
    ranked = speed.withColumn("seq", -F.coalesce("speed_limit", F.lit(0.0)))
    first = attach_attributes(roads, ranked, *dated, dedup="first_by", order_by="seq").where(one).first()
    assert (first.speed_limit, first.road_class) == (60.0, "Local")
    with pytest.raises(ValueError, match="order_by"):
        attach_attributes(roads, speed, lanes, classes, dedup="first_by")
    with pytest.raises(ValueError, match="dedup"):
        attach_attributes(roads, speed, lanes, classes, dedup="last")


def test_missing_keys_match_only_on_request(inputs):
    missing = F.col("ogf_id").isNull()
    assert attach_attributes(*inputs).where(missing).first().speed_limit is None
    assert attach_attributes(*inputs, null_safe=True).where(missing).first().speed_limit == 90.0


def test_column_checks(spark, inputs):
    roads, speed, *rest = inputs
    with pytest.raises(ValueError, match="speed_limit"):
        attach_attributes(roads, speed.drop("speed_limit"), *rest)
    with pytest.raises(ValueError, match="already have"):
        attach_attributes(roads.withColumn("speed_limit", F.lit(1.0)), speed, *rest)
    with pytest.raises(ValueError, match="NEIGHBOURHOOD"):
        require_columns(roads, "NEIGHBOURHOOD")
    df = spark.createDataFrame([(1, 2, 3)], f"ogf_id int, {KEY.upper()}_class int, other int")
    assert drop_prefixed(df).columns == ["ogf_id", "other"]


def test_zero_fill_and_bad_numbers(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), True), (2.5, False)], "a double, b boolean")
    assert [tuple(r) for r in df.select(zero_filled("a"), zero_filled("b")).collect()] == [(0, 0), (0, 1), (2.5, 0)]
    with pytest.raises(NumberFormatException):
        spark.createDataFrame([("fast",)], "a string").select(zero_filled("a")).collect()
