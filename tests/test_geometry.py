import numpy as np
import pytest
from helpers import distance, utm

from segrisk.functions.geometry import with_cells, with_direction, within
from segrisk.functions.projection import assert_geographic, central_meridian, with_utm


def project(spark, points, zone=17):
    df = spark.createDataFrame(points, "lon double, lat double")
    return [(r.x, r.y) for r in with_utm(df, ("lon", "lat", "x", "y"), zone=zone).collect()]


def test_landmark(spark):
    ((x, y),) = project(spark, [(-79.387139, 43.642567)])
    assert abs(x - 630084) < 1 and abs(y - 4833438) < 1


def test_meridian_and_equator(spark):
    (a, b) = project(spark, [(-81.0, 45.0), (-81.0, 0.0)])
    assert a[0] == pytest.approx(500000, abs=1e-6) and b == pytest.approx((500000, 0), abs=1e-6)
    assert a[1] == pytest.approx(0.9996 * 4984944.378, abs=1e-2)


def test_agrees_with_another_series(spark):
    rng = np.random.default_rng(1)
    points = [(float(a), float(b)) for a, b in rng.uniform([-82, -60], [-78, 60], (200, 2))]
    got = np.array(project(spark, points))
    x, y = utm(*np.array(points).T)
    assert np.abs(got - np.column_stack([x, y])).max() < 0.005


def test_missing_is_nan_and_another_zone_works(spark):
    (missing,) = project(spark, [(None, 43.0)])
    assert np.isnan(missing).all()
    ((x, _),) = project(spark, [(-75.0, 45.0)], zone=18)
    assert x == pytest.approx(500000, abs=1e-6)
    with pytest.raises(ValueError):
        central_meridian(61)


def test_coordinate_system_must_be_geographic():
    assert assert_geographic(None) == assert_geographic("epsg:4326") == "EPSG:4326"
    with pytest.raises(ValueError, match="EPSG:32617"):
        assert_geographic("EPSG:32617")


def near(spark, point, part, radius=10.0):
    row = [(*map(float, point), *map(float, part))]
    df = spark.createDataFrame(row, "_x double, _y double, x1 double, y1 double, x2 double, y2 double")
    return with_direction(df).where(within(radius)).count() == 1


def test_radius_boundary_is_outside(spark):
    part = (600000, 4800000, 600100, 4800000)
    assert near(spark, (600050, 4800009.9), part)
    assert not near(spark, (600050, 4800010.0), part)
    assert near(spark, (600109.9, 4800000), part)
    assert not near(spark, (600110.0, 4800000), part)
    assert not near(spark, (600108, 4800008), part)


def test_part_without_length(spark):
    part = (600000, 4800000, 600000, 4800000)
    assert near(spark, (600000, 4800009.9), part)
    assert near(spark, (600007, 4800007), part)
    assert not near(spark, (600008, 4800008), part)


@pytest.mark.parametrize("cell", [7.0, 64.0, 500.0])
def test_cells_cover_every_near_point(spark, cell):
    rng = np.random.default_rng(int(cell))
    starts = rng.uniform([590000, 4.8e6], [640000, 4.85e6], (60, 2))
    spans = rng.normal(0, 300, (60, 2))
    spans[:10, 0] = rng.choice([0, 1e-9, 1e-4, 0.5, -0.999, 1.001], 10)
    spans[10:15, 1] = 0
    spans[15:20] = 0
    spans[20:25] *= 30
    parts = [(i, *map(float, (*a, *(a + d)))) for i, (a, d) in enumerate(zip(starts, spans))]
    df = spark.createDataFrame(parts, "id long, x1 double, y1 double, x2 double, y2 double")
    rows = [(r.id, r.cx, r.cy) for r in with_cells(df, 10.0, cell).select("id", "cx", "cy").collect()]
    cells = set(rows)
    assert len(rows) == len(cells), "a cell is listed once per part"
    checked = 0
    for i, x1, y1, x2, y2 in parts:
        t = rng.uniform(-0.02, 1.02, (400, 1))
        points = np.array([x1, y1]) + t * np.array([x2 - x1, y2 - y1]) + rng.uniform(-10, 10, (400, 2))
        inside = points[distance(points[:, 0], points[:, 1], x1, y1, x2, y2) < 10]
        checked += len(inside)
        assert all((i, int(a), int(b)) in cells for a, b in np.floor(inside / cell))
    assert checked > 5000


def test_diagonal_costs_a_line_of_cells(spark):
    df = spark.createDataFrame([(0.0, 0.0, 64000.0, 64000.0)], "x1 double, y1 double, x2 double, y2 double")
    assert with_cells(df, 10.0, 64.0).count() < 4 * 1001
    off_globe = spark.createDataFrame([(0.0, 0.0, 1e12, 0.0)], df.schema)
    assert with_cells(off_globe, 10.0, 64.0).count() == 0


def test_within_equals_the_distance_to_the_part(spark):
    """Points before, beside and past parts of any direction, parts without length, and the boundary itself."""
    rng = np.random.default_rng(5)
    rows = [(*rng.uniform(-30, 30, 4), *rng.uniform(-40, 40, 2)) for _ in range(2000)]
    rows += [(0.0, 0.0, 0.0, 0.0, x, 0.0) for x in (0.0, 9.999, 10.0, 10.001)]
    rows += [(0.0, 0.0, 20.0, 0.0, x, y) for x, y in ((-10.0, 0.0), (30.0, 0.0), (29.999, 0.0), (10.0, 10.0), (0.0, -9.999), (20.0, 10.0))]
    rows += [(0.0, 0.0, 20.0, 0.0, float("nan"), 0.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x1 double, y1 double, x2 double, y2 double, _x double, _y double")
    found = [r.near for r in with_direction(df).selectExpr(f"{within(10.0)} AS near").collect()]
    far = [distance(np.array([x]), np.array([y]), a, b, c, d)[0] for a, b, c, d, x, y in rows]
    assert found == [d < 10.0 for d in far] and 100 < sum(found) < 1500
    # Comparisons that most rows fail come before any overshoot is computed.
    assert "greatest" not in within(10.0)
