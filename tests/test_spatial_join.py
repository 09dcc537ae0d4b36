import io
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import numpy as np
import pytest
from helpers import brute_force_pairs, crashes_df, distance, random_network, roads_df
from pyspark.sql import functions as F

from segrisk.functions.geometry import cell_of, with_cells, with_direction, within
from segrisk.operators import spatial_join
from segrisk.operators.spatial_join import (
    crash_counts,
    segments_with_crashes,
    segments_with_crashes_total,
    spatial_join_pairs,
    top_crash_segments,
    unmatched_crashes,
    with_crash_counts,
)
from segrisk.session import ALL_JOIN_KEYS

LON, LAT = -79.4, 43.65
METRE_N = 1 / 111100  # about one metre northwards


def pairs(spark, roads, crashes, **options):
    df = spatial_join_pairs(crashes_df(spark, crashes), roads_df(spark, roads), **options)
    rows = [tuple(r) for r in df.select("crash_id", "ogf_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def counts(spark, roads, crashes, **options):
    df = crash_counts(roads_df(spark, roads), crashes_df(spark, crashes), **options)
    return {r.ogf_id: r.crash_count for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"cell": 11.0}, {"cell": 300.0}, {"block_rows": 3}])
def test_equals_brute_force(spark, options):
    roads, crashes = random_network(seed=7)
    expected = brute_force_pairs(crashes, roads)
    assert len(expected) > 300
    assert pairs(spark, roads, crashes, **options) == expected
    per_segment = dict(Counter(ogf_id for _, ogf_id in expected))
    assert counts(spark, roads, crashes, mode="segments", **options) == per_segment
    assert counts(spark, roads, crashes, mode="rows", **options) == per_segment


@pytest.mark.parametrize("block_rows", [5, 50_000])
def test_a_third_of_everything_at_one_place(spark, block_rows):
    roads, crashes = random_network(seed=8, n_roads=40, n_crashes=300)
    hot = roads[0][1][0][0]
    crashes += [(1000 + i, *hot) for i in range(150)]
    roads += [(100 + i, [[hot, (hot[0], hot[1] + 0.0001)]], None) for i in range(20)]
    roads += [(200, [[hot, (hot[0], hot[1] - 0.0001)]], None)] * 20
    expected = brute_force_pairs(crashes, roads)
    assert pairs(spark, roads, crashes, block_rows=block_rows) == expected
    per_segment = Counter(ogf_id for _, ogf_id in expected)
    assert counts(spark, roads, crashes, mode="segments", block_rows=block_rows) == per_segment
    per_segment[200] *= 20
    assert counts(spark, roads, crashes, mode="rows", block_rows=block_rows) == per_segment


def test_crash_at_a_bend_counts_once_and_near_two_segments_twice(spark):
    bend = (1, [[(LON, LAT), (LON + 0.001, LAT), (LON + 0.001, LAT + 0.001)]], None)
    parallel = (2, [[(LON, LAT + 5 * METRE_N), (LON + 0.001, LAT + 5 * METRE_N)]], None)
    at_bend, between = (1, LON + 0.001, LAT), (2, LON + 0.0005, LAT + 2 * METRE_N)
    assert pairs(spark, [bend, parallel], [at_bend, between]) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert counts(spark, [bend, parallel], [at_bend, between]) == {1: 2, 2: 2}


def test_missing_coordinates_and_geometries(spark):
    road = (1, [[(LON, LAT), (LON + 0.001, LAT)]], None)
    odd = [(2, None, None), (3, [[(LON, LAT)]], None), (4, [], None), (5, [[(LON, LAT), (None, LAT)]], None)]
    odd += [(None, [[(LON, LAT), (LON + 0.001, LAT)]], None)]
    crashes = [
        (1, LON, LAT), (2, None, LAT), (3, float("nan"), LAT), (4, LON, None), (5, LON + 1, LAT),
        (6, 999.0, LAT), (7, LON, float("inf")), (8, 9.0, 0.0),
    ]
    assert pairs(spark, [road, *odd], crashes) == {(1, 1), (1, None)}
    assert counts(spark, [road, *odd], crashes) == {1: 1}
    c, r = crashes_df(spark, crashes), roads_df(spark, [road, *odd])
    assert {x.crash_id for x in unmatched_crashes(c, r).collect()} == {5, 6, 7, 8}
    everything = unmatched_crashes(c, r, keep_missing=True)
    assert {x.crash_id for x in everything.collect()} == {2, 3, 4, 5, 6, 7, 8}


def test_count_modes_with_repeated_ids(spark):
    line = [[(LON, LAT), (LON + 0.001, LAT)]]
    other = [[(LON, LAT + 4 * METRE_N), (LON + 0.001, LAT + 4 * METRE_N)]]
    far = [[(LON + 0.1, LAT), (LON + 0.101, LAT)]]
    roads = [(1, line, None), (1, line, "A"), (1, other, None), (2, line, None), (3, far, None)]
    crashes = [(1, LON + 0.0002, LAT), (2, LON + 0.0002, LAT), (3, LON + 0.0004, LAT)]
    assert counts(spark, roads, crashes, mode="rows") == {1: 9, 2: 3}
    assert counts(spark, roads, crashes, mode="segments") == {1: 3, 2: 3}
    weighted = roads_df(spark, roads).withColumn("copies", F.lit(10).cast("bigint"))
    total = crash_counts(weighted, crashes_df(spark, crashes), mode="rows")
    assert {r.ogf_id: r.crash_count for r in total.collect()} == {1: 90, 2: 30}
    table = with_crash_counts(roads_df(spark, roads), crashes_df(spark, crashes), mode="segments")
    assert sorted((r.ogf_id, r.crash_count) for r in table.collect()) == [(1, 3)] * 3 + [(2, 3), (3, 0)]
    assert segments_with_crashes(table).count() == 4
    assert segments_with_crashes_total(table).first().asDict() == {"n_rows": 4, "n_segments": 2}
    assert [tuple(r) for r in top_crash_segments(table, 1).collect()] == [(1, 3)]
    with pytest.raises(ValueError, match="mode"):
        crash_counts(table, table, mode="points")
    with pytest.raises(ValueError, match="longitude"):
        crash_counts(table, table)


def test_plans(spark):
    roads, crashes = random_network(seed=9, n_roads=5, n_crashes=5)
    r, c = roads_df(spark, roads), crashes_df(spark, crashes)
    for df in (crash_counts(r, c), crash_counts(r, c, mode="segments"), spatial_join_pairs(c, r)):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        plan = out.getvalue()
        assert not re.search("NestedLoop|Cartesian|EvalPython|InPandas|InArrow", plan)
        assert plan.count("SortMergeJoin") >= 1
    # The pairs are made distinct inside the join's partitions: join, distinct, no exchange in between.
    plan = spatial_join_pairs(c, r)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Exchange")


def test_counts_hold_no_pairs(spark):
    """Above the join nothing is kept per position: hits of a dense network are added up as they are found."""
    roads, crashes = random_network(seed=9, n_roads=5, n_crashes=5)
    r = roads_df(spark, roads)
    c = crashes_df(spark, crashes).selectExpr("*", "1 AS hour", "'dry' AS weather")
    for df in (crash_counts(r, c), crash_counts(r, c, mode="segments"), spatial_join.crash_counts_cube(r, c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.rindex("SortMergeJoin")]
        assert "SortMergeJoin" in plan and not re.search(r"Aggregate\(keys=\[[^\]]*longitude", above)
        assert not re.search(r"Exchange [^\n]*longitude", above)


def test_many_parts_of_a_segment_in_a_cell(spark):
    """A zigzag whose parts lie in few cells, and another geometry of its id: a crash counts once per row or id."""
    zigzag = [(LON + 0.00002 * (i % 2), LAT + i * METRE_N) for i in range(25)]
    roads = [(1, [zigzag], None), (1, [zigzag[::-1][:7]], None), (2, [zigzag[:3]], None)]
    crashes = [(i, LON + 0.00001, LAT + i * METRE_N) for i in range(25)]
    expected = brute_force_pairs(crashes, roads)
    assert pairs(spark, roads, crashes) == expected
    per_id = Counter(ogf_id for _, ogf_id in expected)
    assert counts(spark, roads, crashes, mode="segments") == per_id
    rows = Counter(ogf_id for road in roads for _, ogf_id in brute_force_pairs(crashes, [road]))
    assert counts(spark, roads, crashes, mode="rows") == rows


def test_generated_code_stays_within_the_jit_limit(spark):
    roads, crashes = random_network(seed=9, n_roads=5, n_crashes=5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            crash_counts(roads_df(spark, roads), crashes_df(spark, crashes)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(-?\d+)", out.getvalue())]
    assert sizes and all(0 < s < 8000 for s in sizes), sizes


def test_unmatched_crashes_are_decided_by_position(spark):
    roads = [(1, [[(LON, LAT), (LON + 0.01, LAT)]], "A")]
    rows = [(None, LON, LAT), (2, LON, LAT + 0.1), (2, LON, LAT), (3, LON, 95.0), (4, None, LAT), (None, LON, LAT + 0.2)]
    crashes = spark.createDataFrame(rows, "crash_id long, longitude double, latitude double")
    found = {tuple(r) for r in unmatched_crashes(crashes, roads_df(spark, roads)).collect()}
    assert found == {rows[1], rows[3], rows[5]}
    kept = unmatched_crashes(crashes, roads_df(spark, roads), keep_missing=True)
    assert {tuple(r) for r in kept.collect()} == {rows[1], rows[3], rows[4], rows[5]}


def test_rows_per_leaf_are_bounded(spark):
    """A third of everything in one place, and other cells that are crowded a little."""
    rng = random.Random(4)
    limit = 40
    points = [(i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(400)]
    points += [(1000 + i, 100.5, 100.5) for i in range(900)] + [(3000 + i, rng.uniform(32, 64), rng.uniform(32, 64)) for i in range(150)]
    parts = [(i, rng.uniform(0, 180), rng.uniform(0, 180), rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(300)]
    parts += [(1000 + i, 100.0, 100.0, 1.0, 1.0) for i in range(300)]
    p = spark.createDataFrame(points, "point long, _x double, _y double")
    p = p.selectExpr("*", f"{cell_of('_x', 32)} AS cx", f"{cell_of('_y', 32)} AS cy")
    s = spark.createDataFrame([(i, x, y, x + a, y + b) for i, x, y, a, b in parts], "line long, x1 double, y1 double, x2 double, y2 double")
    s = with_direction(with_cells(s, 10.0, 32.0))
    leaf_points, leaf_parts, cells = spatial_join._leaves(p, ["point"], s, ["line"], 10.0, 32.0, limit)
    fullest = [df.groupBy(*cells).count().agg(F.max("count")).first()[0] for df in (leaf_points, leaf_parts)]
    assert max(fullest) <= 3 * limit  # blocks are dealt by hash
    # A row is repeated for the blocks of its own cell only: 900 points are 23 blocks, the parts of that cell 8 or more.
    once = leaf_points.where("point < 1000 OR point >= 3000").groupBy("point").count()
    assert once.where(F.col("count") > 1).count() < 60  # neighbours of the hot place
    # All pairs within the radius are found, each in one leaf.
    found = leaf_points.alias("p").join(leaf_parts.alias("s"), cells).where(within(10.0)).select("point", "line", *cells).distinct()
    pairs = {(r.point, r.line) for r in found.collect()}
    assert len(pairs) == found.count()
    expected = {
        (i, j) for i, x, y in points for j, a, b, dx, dy in parts
        if abs(x - a) < 40 and abs(y - b) < 40 and distance(np.array([x]), np.array([y]), a, b, a + dx, b + dy)[0] < 10
    }
    assert pairs == expected


def test_any_number_of_crowded_cells(spark):
    roads, crashes = random_network(seed=11)
    expected = brute_force_pairs(crashes, roads)
    assert pairs(spark, roads, crashes, block_rows=1) == expected


def test_crashes_are_scanned_once_for_pairs(spark, tmp_path):
    roads, crashes = random_network(seed=3)
    crashes_df(spark, crashes).write.parquet(f"{tmp_path}/crashes")
    joined = spatial_join_pairs(spark.read.parquet(f"{tmp_path}/crashes"), roads_df(spark, roads))
    assert all("/crashes" not in name for name in joined.inputFiles())  # they were read, projected and written before


def test_cube_holds_every_filter(spark):
    roads, crashes = random_network(seed=21)
    rng = random.Random(5)
    rows = [(*c, rng.choice([None, 0, 6, 12, 18, 23]), rng.choice([None, "dry", "wet", "snow"])) for c in crashes]
    rows += rows[:50]
    c = spark.createDataFrame(rows, "crash_id long, longitude double, latitude double, hour int, weather string")
    r = roads_df(spark, roads)
    cube = spatial_join.crash_counts_cube(r, c).cache()
    for hours, weather in ((None, None), ((6, 18), None), (None, ("wet", "snow")), ((0, 12), ("dry",))):
        kept = c
        if hours:
            kept = kept.where(F.col("hour").between(*hours))
        if weather:
            kept = kept.where(F.col("weather").isin(*weather))
        want = {x.ogf_id: x.crash_count for x in crash_counts(r, kept, mode="segments").collect()}
        assert {x.ogf_id: x.crash_count for x in spatial_join.counts_of(cube, hours, weather).collect()} == want
    everything = cube.where("all_hours AND all_weather").count()
    missing = cube.where("NOT all_hours AND hour IS NULL AND all_weather").count()
    assert everything > 0 and missing > 0 and cube.count() == cube.select("ogf_id", "hour", "weather", "all_hours", "all_weather").distinct().count()


@pytest.mark.parametrize("options", [{}, {"block_rows": 20}])
def test_both_sides_of_a_zone_border(spark, options):
    """A network over 78 degrees west, tested in the zone of each crash; the default zone gives nearly the same here."""
    roads, crashes = random_network(seed=23)
    shift = 1.395
    roads = [(i, [[(x + shift, y) for x, y in line] for line in lines], d) for i, lines, d in roads]
    crashes = [(i, x + shift, y) for i, x, y in crashes]
    sides = {x > -78 for _, x, _ in crashes}
    assert sides == {True, False}
    west = brute_force_pairs([c for c in crashes if c[1] < -78], roads, zone=17)
    east = brute_force_pairs([c for c in crashes if c[1] >= -78], roads, zone=18)
    assert pairs(spark, roads, crashes, zone=None, **options) == west | east
    crossing = {i for i, lines, _ in roads if len({x > -78 for line in lines for x, _ in line}) == 2}
    assert {s for _, s in west} & {s for _, s in east} & crossing


def test_far_from_the_zone(spark):
    europe = [(1, [[(10.0, 50.0), (10.001, 50.0)]], None)]
    crash = [(1, 10.0005, 50.0), (2, 10.0005, 50.0 + 12 * METRE_N)]
    with pytest.raises(Exception, match="not near UTM zone 17"):
        pairs(spark, europe, crash)
    assert pairs(spark, europe, crash, zone=32) == pairs(spark, europe, crash, zone=None) == {(1, 1)}
    edge = [(1, [[(179.9999, 0.0), (180.0, 0.0)]], None), (2, [[(-180.0, 1.0), (-179.9999, 1.0)]], None)]
    assert pairs(spark, edge, [(1, 180.0, 0.0), (2, -180.0, 1.0)], zone=None) == {(1, 1), (2, 2)}


@pytest.mark.parametrize("zone", [17, None])
def test_pairs_leave_the_join_as_they_are_found(spark, zone):
    """Where no id repeats in a cell, nothing above the join holds pairs, and both sides are dealt out once."""
    roads, crashes = random_network(seed=31, n_roads=20, n_crashes=200)
    joined = spatial_join_pairs(crashes_df(spark, crashes), roads_df(spark, roads), zone=zone)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    between = plan[plan.index("SortMergeJoin") : plan.rindex("SortMergeJoin")]
    assert "Aggregate" not in above and "Exchange" not in above
    assert between.count("Exchange") == 2
    found = [tuple(r) for r in joined.collect()]
    assert len(found) == len(set(found)) > 50 and set(found) == brute_force_pairs(crashes, roads)


@pytest.mark.parametrize("zone", [17, None])
@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_crashes_of_one_id_in_a_cell_count_as_one(spark, zone, block_rows):
    """Rows that come twice, ids with several positions beside each other, and crashes without an id."""
    road = (1, [[(LON, LAT), (LON + 0.001, LAT)]], None)
    other = (2, [[(LON, LAT), (LON + 0.001, LAT)]], None)
    here, beside = (LON + 0.0005, LAT), (LON + 0.0005 + 1e-7, LAT + 1e-7)
    crashes = [(1, *here), (1, *here), (2, *here), (2, *beside), (None, *here), (None, *beside), (None, *here), (3, *beside)]
    expected = {(i, s) for i in (1, 2, None, 3) for s in (1, 2)}
    assert pairs(spark, [road, other], crashes, zone=zone, block_rows=block_rows) == expected
    once = [c for c in crashes if c[0] in (1, 3)]
    assert pairs(spark, [road, other], once, zone=zone, block_rows=block_rows) == {p for p in expected if p[0] in (1, 3)}


def test_cube_is_shuffled_in_a_row_per_segment_and_weather(spark):
    """Hits are added up beside the join, hours are columns of the only rows that are shuffled."""
    roads, crashes = random_network(seed=32, n_roads=20, n_crashes=200)
    rows = [(*c, i % 24, "dry") for i, c in enumerate(crashes)]
    c = spark.createDataFrame(rows, "crash_id long, longitude double, latitude double, hour int, weather string")
    before = spark.conf.get(ALL_JOIN_KEYS)
    spark.conf.set(ALL_JOIN_KEYS, "false")
    try:
        cube = spatial_join.crash_counts_cube(roads_df(spark, roads), c)
        plan = cube._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(ALL_JOIN_KEYS, before)
    above = plan[: plan.rindex("SortMergeJoin")]
    assert not re.search(r"Aggregate\(keys=\[[^\]]*hour", above)
    first = above[: above.index("SortMergeJoin")]
    assert re.findall(r"Exchange (\w+\(\w+)", first) == ["hashpartitioning(ogf_id"]


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "string"])
def test_cube_with_any_hours(spark, kind):
    """Hours beyond a day, below zero and missing ones; types that are not small whole numbers too."""
    roads, crashes = random_network(seed=33, n_roads=15, n_crashes=200)
    hours = [None, 0, 23, 24, 47, -1, -24, 127, 100, -128]
    if kind == "int":
        hours += [2**31 - 1, -(2**31)]
    rows = [(*c, str(h) if (h := hours[i % len(hours)]) is not None else None, ["wet", None][i % 2]) for i, c in enumerate(crashes)]
    c = spark.createDataFrame(rows, "crash_id long, longitude double, latitude double, hour string, weather string")
    cube = spatial_join.crash_counts_cube(roads_df(spark, roads), c.withColumn("hour", F.col("hour").cast(kind)))
    assert dict(cube.dtypes)["hour"] == kind and cube.columns == ["ogf_id", "hour", "weather", "all_hours", "all_weather", "crash_count"]
    known = {i: (h, w) for i, _, _, h, w in rows}
    expected = Counter()
    for i, s in brute_force_pairs(crashes, roads):
        h, w = known[i]
        for all_hours in (False, True):
            for all_weather in (False, True):
                expected[s, None if all_hours else h, None if all_weather else w, all_hours, all_weather] += 1
    got = [(r.ogf_id, None if r.hour is None else str(r.hour), r.weather, r.all_hours, r.all_weather, r.crash_count) for r in cube.collect()]
    assert len(got) == len(expected) > 100 and {g[:5]: g[5] for g in got} == expected
