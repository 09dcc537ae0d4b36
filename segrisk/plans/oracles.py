"""Plain SQL for every query that SQL can express, over the same benchmark tables.

The SQL shares the texts of the derived inputs (``fixtures``) with the queries, and no code with the operators: distances are tested for all pairs, joins fan out, and histogram bins
are found by comparing with every edge.
"""

from __future__ import annotations

import re

from segrisk.plans import fixtures as fx

# WGS84 transverse Mercator, zone 17, third-order series.
_E = "0.08181919084262149"
_R = "6364902.166165086"
_A = ("0.0008377318188192541", "7.608496958699166e-07", "1.2034877875966646e-09")


def _utm(lon: str, lat: str, x: str, y: str, source: str, meridian: str = "-81.0") -> str:
    east = " + ".join(
        ["eta", *(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_A, 1))]
    )
    north = " + ".join(
        ["xi", *(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_A, 1))]
    )
    return f"""
  SELECT * EXCLUDE (t, xi, eta), 500000.0 + {_R} * ({east}) AS {x}, {_R} * ({north}) AS {y}
  FROM (SELECT *, atan2(t, cos(radians({lon} - ({meridian})))) AS xi,
               atanh(sin(radians({lon} - ({meridian}))) / sqrt(1 + t * t)) AS eta
        FROM (SELECT *, sinh(atanh(sin(radians({lat}))) - {_E} * atanh({_E} * sin(radians({lat})))) AS t
              FROM ({source})))"""


_LINES = """
  SELECT ogf_id, lon0 AS lon1, lat0 AS lat1, lon0 + dx1 AS lon2, lat0 + dy1 AS lat2 FROM roads_fx
  UNION ALL
  SELECT ogf_id, lon0 + dx1, lat0 + dy1, lon0 + dx1 + dx2, lat0 + dy1 + dy2 FROM roads_fx"""

def _pairs(points: str, parts: str = "parts", same: str = "true") -> str:
    """All pairs of a point and a part, tested by distance."""
    return f"""
  SELECT DISTINCT crash_id, ogf_id FROM (
    SELECT p.crash_id, s.ogf_id, p.x, p.y, s.x1, s.y1, s.x2, s.y2,
      greatest(0.0, least(1.0, coalesce(((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1))
        / nullif(pow(s.x2 - s.x1, 2) + pow(s.y2 - s.y1, 2), 0), 0.0))) AS t
    FROM {points} p JOIN {parts} s ON {same})
  WHERE pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2) < 100"""


_SCORES = """count(*) AS n_rows,
  {r}
  round(1 - sum(pow(crash_count - prediction, 2)) / nullif(var_pop(crash_count) * count(*), 0), 6) AS r2,
  round(sqrt(avg(pow(crash_count - prediction, 2))), 6) AS rmse"""
_PEARSON = """round(covar_pop(crash_count, prediction)
    / nullif(stddev_pop(crash_count) * stddev_pop(prediction), 0), 6) AS pearson_r,"""

# The Poisson(1) distribution function times 2**31 - 1, rounded up.
_LIMITS = (
    790015084, 1580030168, 1975037710, 2106706891, 2139624186, 2146207645, 2147304888, 2147461638, 2147481231,
    2147483408, 2147483626, 2147483646,
)


def _draws(rows: str = "model", more: str = "") -> str:
    """How often each of 100 trees draws each row: the quantile of a hash of id, running number and tree."""
    p = 2147483647
    return f"""
  SELECT * FROM (SELECT * EXCLUDE (h), {" + ".join(f"CAST(h >= {x} AS BIGINT)" for x in _LIMITS)} AS w
  FROM (SELECT * EXCLUDE (h), (h * h + 88675123) % {p} AS h FROM
  (SELECT * EXCLUDE (h), (h * h + 521288629) % {p} AS h FROM
  (SELECT * EXCLUDE (h), tree, (h * h + tree * 362436069 % {p}) % {p} AS h FROM
  (SELECT * EXCLUDE (h), (h * h + copy) % {p} AS h FROM
  (SELECT *, (ogf_id % {p} * 1103515245 + 42) % {p} AS h, row_number() OVER (PARTITION BY ogf_id, {more}speed_limit,
    number_of_lanes, high_speed, crash_count) AS copy FROM {rows})), range(100) t(tree))))) WHERE w > 0"""


def _forest(rows: str, keys: str) -> str:
    return f"SELECT {keys}, tree, sum(w) AS n, sum(w * crash_count) AS s FROM {rows} GROUP BY ALL"


def _forest_cells(forest: str, asked: str, features: tuple[str, ...], by: tuple[str, ...] = ()) -> str:
    """The mean over trees of the mean of all features, of all but the last, and so on, that a tree has first."""
    joins, means = [], []
    for level in range(len(features), -1, -1):
        keys = ", ".join([*by, "tree", *features[:level]])
        on = " AND ".join(f"l{level}.{k} IS NOT DISTINCT FROM a.{k}" for k in [*by, "tree", *features[:level]])
        joins.append(f"LEFT JOIN (SELECT {keys}, sum(s) / sum(n) AS m FROM {forest} GROUP BY ALL) l{level} ON {on}")
        means.append(f"l{level}.m")
    keys = ", ".join(f"a.{k}" for k in [*by, *features])
    return f"""
  SELECT {keys}, avg(coalesce({", ".join(means)})) AS prediction
  FROM (SELECT * FROM {asked}, range(100) t(tree)) a {" ".join(joins)} GROUP BY {keys}"""


# Named intermediate results, in dependency order.
_CTES = {
    "roads_fx": fx.ROADS.format(**fx.DUCKDB_DIALECT),
    "speed_fx": fx.SPEED.format(**fx.DUCKDB_DIALECT),
    "lanes_fx": fx.LANES.format(**fx.DUCKDB_DIALECT),
    "class_fx": fx.CLASSES.format(**fx.DUCKDB_DIALECT),
    "crashes_fx": fx.CRASHES.format(**fx.DUCKDB_DIALECT),
    "dated": """
  SELECT *, try_strptime(date, '%m/%d/%Y %I:%M:%S %p') AS datetime FROM crashes_fx
  WHERE longitude IS NOT NULL AND latitude IS NOT NULL""",
    "calendar": """
  SELECT crash_id, date, datetime, CAST(hour(datetime) AS INTEGER) AS hour,
    CAST(isodow(datetime) - 1 AS INTEGER) AS weekday, CAST(month(datetime) AS INTEGER) AS month,
    CAST(year(datetime) AS INTEGER) AS year,
    CASE isodow(datetime) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu'
      WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' WHEN 7 THEN 'Sun' END AS weekday_name, weather
  FROM dated WHERE datetime IS NOT NULL""",
    "features": """
  SELECT r.ogf_id, r.district, s.speed_limit,
    CAST(trunc(coalesce(l.number_of_lanes, 1)) AS INTEGER) AS number_of_lanes,
    c.road_class, coalesce(s.speed_limit > 50, false) AS high_speed
  FROM roads_fx r LEFT JOIN speed_fx s ON r.ogf_id = s.id
    LEFT JOIN lanes_fx l ON r.ogf_id = l.id LEFT JOIN class_fx c ON r.ogf_id = c.id""",
    "points": _utm(
        "longitude",
        "latitude",
        "x",
        "y",
        "SELECT crash_id, longitude, latitude FROM crashes_fx WHERE longitude IS NOT NULL AND latitude IS NOT NULL",
    ),
    "parts": _utm("lon2", "lat2", "x2", "y2", _utm("lon1", "lat1", "x1", "y1", _LINES)),
    "hits": _pairs("points"),
    "zone_points": _utm("longitude", "latitude", "x", "y", f"""
  SELECT *, CAST(floor((longitude + 180) / 6) AS INTEGER) + 1 AS zone FROM (
    SELECT crash_id, longitude + 1.39 AS longitude, latitude FROM crashes_fx
    WHERE longitude IS NOT NULL AND latitude IS NOT NULL)""", "zone * 6.0 - 183"),
    "zone_parts": _utm("lon2", "lat2", "x2", "y2", _utm("lon1", "lat1", "x1", "y1", f"""
  SELECT ogf_id, lon1 + 1.39 AS lon1, lat1, lon2 + 1.39 AS lon2, lat2, zone FROM ({_LINES}), (VALUES (17), (18)) z(zone)""",
        "zone * 6.0 - 183"), "zone * 6.0 - 183"),
    "counts_segments": "SELECT ogf_id, count(*) AS n FROM hits GROUP BY ogf_id",
    "counts_rows": """
  SELECT h.ogf_id, count(*) AS n FROM hits h JOIN features f ON h.ogf_id = f.ogf_id GROUP BY h.ogf_id""",
    "segment_rows": """
  SELECT f.*, coalesce(c.n, 0) AS crash_count FROM features f LEFT JOIN counts_rows c ON f.ogf_id = c.ogf_id""",
    "model": """
  SELECT ogf_id, district, coalesce(speed_limit, 0) AS speed_limit,
    CAST(number_of_lanes AS DOUBLE) AS number_of_lanes, CAST(high_speed AS DOUBLE) AS high_speed, crash_count,
    ((ogf_id % 1000003) * 2654435761 + 42) % 1000003 % 5 = 0 AS is_test
  FROM segment_rows""",
    "train_cells": """
  SELECT speed_limit, number_of_lanes, high_speed, sum(crash_count) / count(*) AS mean
  FROM model WHERE NOT is_test GROUP BY ALL""",
    "predictions": """
  SELECT m.*, coalesce(c.mean, (SELECT sum(crash_count) / count(*) FROM model WHERE NOT is_test)) AS prediction
  FROM model m LEFT JOIN train_cells c USING (speed_limit, number_of_lanes, high_speed) WHERE m.is_test""",
    "eligible": """
  SELECT district, count(*) AS n_rows FROM model WHERE district IS NOT NULL GROUP BY district HAVING count(*) >= 10""",
    "folds": """
  SELECT e.district AS fold, m.* FROM eligible e JOIN model m ON m.district IS DISTINCT FROM e.district""",
    "fold_cells": """
  SELECT fold, speed_limit, number_of_lanes, high_speed, sum(crash_count) / count(*) AS mean
  FROM folds GROUP BY ALL""",
    "fold_means": "SELECT fold, sum(crash_count) / count(*) AS mean FROM folds GROUP BY fold",
    "fold_predictions": """
  SELECT m.*, coalesce(c.mean, o.mean) AS prediction
  FROM model m JOIN fold_means o ON o.fold = m.district
    LEFT JOIN fold_cells c ON c.fold = m.district AND c.speed_limit = m.speed_limit
      AND c.number_of_lanes = m.number_of_lanes AND c.high_speed = m.high_speed""",
    "class_cells": """
  SELECT m.ogf_id, f.road_class, m.speed_limit, m.number_of_lanes, m.high_speed, m.crash_count
  FROM segment_rows f JOIN (SELECT DISTINCT ogf_id, district, is_test FROM model) t USING (ogf_id),
    LATERAL (SELECT f.ogf_id, coalesce(f.speed_limit, 0) AS speed_limit, CAST(f.number_of_lanes AS DOUBLE)
      AS number_of_lanes, CAST(f.high_speed AS DOUBLE) AS high_speed, f.crash_count) m
  WHERE NOT t.is_test""",
    "speed_sums": """
  SELECT CAST(count(*) AS DOUBLE) AS n, sum(high_speed) AS n1, CAST(sum(crash_count) AS DOUBLE) AS y,
    CAST(sum(crash_count * high_speed) AS DOUBLE) AS y1 FROM model WHERE NOT is_test""",
    "fold_speeds": """
  SELECT fold, high_speed, sum(crash_count) / count(*) AS mean FROM folds GROUP BY ALL""",
    "fold_poisson": """
  SELECT m.*, c.mean AS prediction FROM model m JOIN fold_speeds c ON c.fold = m.district AND c.high_speed = m.high_speed""",
    "draws": _draws(),
    "forest": _forest("draws WHERE NOT is_test", "speed_limit, number_of_lanes, high_speed"),
    "forest_asked": """
  SELECT DISTINCT speed_limit, number_of_lanes, high_speed FROM model""",
    "forest_cells": _forest_cells("forest", "forest_asked", ("speed_limit", "number_of_lanes", "high_speed")),
    "class_rows": """
  SELECT ogf_id, road_class, coalesce(speed_limit, 0) AS speed_limit, CAST(number_of_lanes AS DOUBLE) AS number_of_lanes,
    CAST(high_speed AS DOUBLE) AS high_speed, crash_count, district,
    ((ogf_id % 1000003) * 2654435761 + 42) % 1000003 % 5 = 0 AS is_test
  FROM segment_rows""",
    "class_draws": _draws("class_rows", "road_class, "),
    "class_forest": _forest("class_draws WHERE NOT is_test", "speed_limit, number_of_lanes, road_class, high_speed"),
    "class_asked": """
  SELECT DISTINCT speed_limit, number_of_lanes, road_class, high_speed FROM class_rows WHERE is_test""",
    "class_forest_cells": _forest_cells(
        "class_forest", "class_asked", ("speed_limit", "number_of_lanes", "road_class", "high_speed")
    ),
    "fold_draws": """
  SELECT e.district AS fold, d.* FROM eligible e JOIN draws d ON d.district IS DISTINCT FROM e.district""",
    "fold_forest": _forest("fold_draws", "fold, speed_limit, number_of_lanes, high_speed"),
    "fold_asked": """
  SELECT DISTINCT district AS fold, speed_limit, number_of_lanes, high_speed FROM model JOIN eligible USING (district)""",
    "fold_forest_cells": _forest_cells(
        "fold_forest", "fold_asked", ("speed_limit", "number_of_lanes", "high_speed"), ("fold",)
    ),
    "fold_forest_predictions": """
  SELECT m.*, c.prediction FROM model m JOIN fold_forest_cells c ON c.fold = m.district AND
    c.speed_limit = m.speed_limit AND c.number_of_lanes = m.number_of_lanes AND c.high_speed = m.high_speed""",
    "ends": "SELECT min(crash_count - prediction) AS lo, max(crash_count - prediction) AS hi FROM predictions",
    "bounds": """
  SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM ends""",
    "bins": """
  SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 30) AS lower,
    CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS upper
  FROM bounds, range(30) r(i)""",
}


def _with(*needed: str) -> str:
    """The WITH clause for ``needed`` and everything they mention."""
    wanted = set(needed)
    for name in reversed(list(_CTES)):
        if name in wanted:
            wanted |= {other for other in _CTES if other != name and re.search(rf"\b{other}\b", _CTES[name])}
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in _CTES.items() if name in wanted)


def _query(body: str, *needed: str) -> str:
    return f"{_with(*needed)}\n{body}"


_ROW_COLUMNS = "ogf_id, district, speed_limit, number_of_lanes, road_class, high_speed"

_PROFILE = """
SELECT 'roads' AS table_name, count(*) AS n_rows, 'ogf_id,lines,district' AS column_names FROM roads_fx
UNION ALL SELECT 'speed', count(*), 'orn_road_net_element_id,speed_limit' FROM speed_fx
UNION ALL SELECT 'lanes', count(*), 'orn_road_net_element_id,number_of_lanes' FROM lanes_fx
UNION ALL SELECT 'road_class', count(*), 'orn_road_net_element_id,road_class' FROM class_fx
UNION ALL SELECT 'crashes', count(*), 'crash_id,longitude,latitude,date,weather,district' FROM crashes_fx"""

_VERTICES = """
SELECT ogf_id, district, 0 AS part, CAST(v AS INTEGER) AS vertex,
  CASE v WHEN 0 THEN lon0 WHEN 1 THEN lon0 + dx1 ELSE lon0 + dx1 + dx2 END AS x,
  CASE v WHEN 0 THEN lat0 WHEN 1 THEN lat0 + dy1 ELSE lat0 + dy1 + dy2 END AS y
FROM roads_fx, range(3) r(v)"""


# Newton's method for intercept b and weight w of one 0/1 feature, penalty w^2 / 2 on the mean half deviance.
_NEWTON = """newton AS (
  SELECT 0 AS i, ln(y / n) AS b, CAST(0 AS DOUBLE) AS w FROM speed_sums
  UNION ALL
  SELECT i + 1, b - (ww * gb - bw * gw) / (bb * ww - bw * bw), w - (bb * gw - bw * gb) / (bb * ww - bw * bw)
  FROM (SELECT i, b, w, ((n - n1) * exp(b) + n1 * exp(b + w) - y) / n AS gb, (n1 * exp(b + w) - y1) / n + w AS gw,
          ((n - n1) * exp(b) + n1 * exp(b + w)) / n AS bb, n1 * exp(b + w) / n AS bw, n1 * exp(b + w) / n + 1 AS ww
        FROM newton, speed_sums) WHERE i < 40)"""


def oracle_sql() -> dict[str, str]:
    calendar = "crash_id, date, datetime, hour, weekday, month, year, weekday_name"
    counted = "SELECT f.ogf_id, f.speed_limit, f.number_of_lanes, f.road_class, coalesce(c.n, 0) AS crash_count FROM features f"
    exported = f"SELECT {_ROW_COLUMNS}, crash_count, 3 AS n_vertices FROM segment_rows"
    filtered = f"""SELECT ogf_id, count(*) AS crash_count FROM ({_pairs('filtered')}) GROUP BY ogf_id"""
    filtered_points = ", filtered AS (SELECT p.* FROM points p JOIN calendar c USING (crash_id)\n"
    filtered_points += "  WHERE c.hour BETWEEN 6 AND 18 AND c.weather IN ('click', 'view'))\n"
    return {
        "scan_attribute_csv": _query(
            "SELECT id AS orn_road_net_element_id, speed_limit FROM speed_fx", "speed_fx"
        ),
        "scan_road_class_csv": _query(
            "SELECT id AS orn_road_net_element_id, road_class FROM class_fx", "class_fx"
        ),
        "scan_crash_csv": _query("SELECT * FROM crashes_fx", "crashes_fx"),
        "scan_geojson_points": _query(
            "SELECT crash_id, date, weather, district, longitude,"
            " CASE WHEN longitude IS NOT NULL THEN latitude END AS latitude FROM crashes_fx",
            "crashes_fx",
        ),
        "scan_geojson_lines": _query(_VERTICES, "roads_fx"),
        "dataset_profile": _query(
            _PROFILE, "roads_fx", "speed_fx", "lanes_fx", "class_fx", "crashes_fx"
        ),
        "export_geojson": _query(exported, "segment_rows"),
        "export_parquet": _query(exported, "segment_rows"),
        "segment_features": _query(f"SELECT {_ROW_COLUMNS} FROM features", "features"),
        "feature_matrix": _query(
            "SELECT ogf_id, speed_limit, number_of_lanes, high_speed, crash_count FROM model", "model"
        ),
        "crash_points": _query(
            "SELECT crash_id, longitude AS x, latitude AS y FROM crashes_fx"
            " WHERE longitude IS NOT NULL AND latitude IS NOT NULL",
            "crashes_fx",
        ),
        "crash_datetime": _query(f"SELECT {calendar} FROM calendar", "calendar"),
        "collisions_by_hour": _query(
            "SELECT hour, count(*) AS n_crashes FROM calendar GROUP BY hour ORDER BY hour", "calendar"
        ),
        "project_points": _query(
            "SELECT crash_id, round(x, 3) AS x, round(y, 3) AS y FROM points", "points"
        ),
        "spatial_join_pairs": _query("SELECT crash_id, ogf_id FROM hits", "hits"),
        "spatial_join_zones": _query(
            f"SELECT crash_id, ogf_id FROM ({_pairs('zone_points', 'zone_parts', 'p.zone = s.zone')})",
            "zone_points",
            "zone_parts",
        ),
        "crash_counts_cube": _query(
            "SELECT ogf_id, hour, weather, grouping(hour) = 1 AS all_hours, grouping(weather) = 1 AS all_weather,"
            " count(*) AS crash_count FROM hits JOIN calendar USING (crash_id)"
            " GROUP BY GROUPING SETS ((ogf_id, hour, weather), (ogf_id, hour), (ogf_id, weather), (ogf_id))",
            "hits",
            "calendar",
        ),
        "scan_crash_csv_quoted": _query(
            "SELECT * REPLACE (weather || chr(10) || '\"in\" ' || district AS weather) FROM crashes_fx", "crashes_fx"
        ),
        "scan_geojson_collection": _query(
            "SELECT crash_id, date, weather, district, longitude,"
            " CASE WHEN longitude IS NOT NULL THEN latitude END AS latitude FROM crashes_fx",
            "crashes_fx",
        ),
        "unmatched_crashes": _query(
            "SELECT crash_id, longitude, latitude FROM points WHERE crash_id NOT IN (SELECT crash_id FROM hits)",
            "hits",
            "points",
        ),
        "crash_count_rows": _query(
            f"{counted} LEFT JOIN counts_rows c ON f.ogf_id = c.ogf_id", "features", "counts_rows"
        ),
        "crash_count_segments": _query(
            f"{counted} LEFT JOIN counts_segments c ON f.ogf_id = c.ogf_id", "features", "counts_segments"
        ),
        "crash_count_filtered": _with("points", "calendar", "parts") + filtered_points + filtered,
        "segments_with_crashes": _query(
            "SELECT ogf_id, crash_count FROM segment_rows WHERE crash_count > 0", "segment_rows"
        ),
        "segments_with_crashes_total": _query(
            "SELECT count(*) AS n_rows, count(DISTINCT ogf_id) AS n_segments FROM segment_rows WHERE crash_count > 0",
            "segment_rows",
        ),
        "top_crash_segments": _query(
            "SELECT ogf_id, n AS crash_count FROM counts_segments ORDER BY n DESC, ogf_id LIMIT 10",
            "counts_segments",
        ),
        "holdout_split": _query("SELECT DISTINCT ogf_id, is_test FROM model", "model"),
        "region_eligible": _query("SELECT district, n_rows FROM eligible", "eligible"),
        "loro_train_sizes": _query(
            "SELECT e.district, e.n_rows AS n_test, count(*) AS n_train"
            " FROM eligible e JOIN folds f ON f.fold = e.district GROUP BY ALL",
            "eligible",
            "folds",
        ),
        "tree_cell_mean": _query(
            "SELECT ogf_id, speed_limit, number_of_lanes, high_speed, round(mean, 6) AS prediction"
            " FROM model JOIN train_cells USING (speed_limit, number_of_lanes, high_speed) WHERE NOT is_test",
            "model",
            "train_cells",
        ),
        "poisson_group_mean": _query(
            "SELECT ogf_id, high_speed, round(avg(crash_count) OVER (PARTITION BY high_speed), 6) AS prediction"
            " FROM model WHERE NOT is_test",
            "model",
        ),
        "load_dataset_counts": _query(
            f"{counted} LEFT JOIN counts_rows c ON f.ogf_id = c.ogf_id", "features", "counts_rows"
        ),
        "load_dataset_formats": _query(
            f"{counted} LEFT JOIN counts_segments c ON f.ogf_id = c.ogf_id", "features", "counts_segments"
        ),
        "tree_road_class": _query(
            "SELECT ogf_id, road_class, speed_limit, number_of_lanes, high_speed, round(avg(crash_count) OVER"
            " (PARTITION BY road_class, speed_limit, number_of_lanes, high_speed), 6) AS prediction FROM class_cells",
            "class_cells",
        ),
        "poisson_penalised": _with("model", "speed_sums").replace("WITH ", "WITH RECURSIVE ", 1)
        + f", {_NEWTON}\nSELECT ogf_id, high_speed, round(exp(b + w * high_speed), 6) AS prediction"
        " FROM model, (SELECT b, w FROM newton WHERE i = 40) WHERE NOT is_test",
        "risk_cell_mean": _query(
            f"SELECT {_ROW_COLUMNS.replace('speed_limit', 'r.speed_limit').replace('number_of_lanes', 'r.number_of_lanes').replace('high_speed', 'r.high_speed')},"
            " crash_count, round(coalesce(c.mean, (SELECT sum(crash_count) / count(*) FROM model WHERE NOT is_test)), 6)"
            " AS predicted_risk FROM segment_rows r LEFT JOIN train_cells c ON c.speed_limit = coalesce(r.speed_limit, 0)"
            " AND c.number_of_lanes = r.number_of_lanes AND c.high_speed = CAST(r.high_speed AS DOUBLE)",
            "segment_rows",
            "train_cells",
            "model",
        ),
        "rf_hash_bootstrap": _query(
            "SELECT ogf_id, district, speed_limit, number_of_lanes, high_speed, crash_count,"
            " round(prediction, 6) AS prediction"
            " FROM model JOIN forest_cells USING (speed_limit, number_of_lanes, high_speed) WHERE is_test",
            "model",
            "forest_cells",
        ),
        "rf_hash_road_class": _query(
            "SELECT ogf_id, district, r.road_class, r.speed_limit, r.number_of_lanes, r.high_speed, crash_count,"
            " round(prediction, 6) AS prediction FROM class_rows r JOIN class_forest_cells c"
            " ON c.speed_limit = r.speed_limit AND c.number_of_lanes = r.number_of_lanes"
            " AND c.high_speed = r.high_speed AND c.road_class IS NOT DISTINCT FROM r.road_class WHERE is_test",
            "class_rows",
            "class_forest_cells",
        ),
        "risk_scores": _query(
            "SELECT ogf_id, district, r.speed_limit, r.number_of_lanes, road_class, r.high_speed, crash_count,"
            " round(prediction, 6) AS predicted_risk FROM segment_rows r JOIN forest_cells c"
            " ON c.speed_limit = coalesce(r.speed_limit, 0) AND c.number_of_lanes = r.number_of_lanes"
            " AND c.high_speed = CAST(r.high_speed AS DOUBLE)",
            "segment_rows",
            "forest_cells",
        ),
        "loro_metrics": _query(
            f"SELECT district, {_SCORES.format(r=_PEARSON)} FROM fold_forest_predictions GROUP BY district",
            "fold_forest_predictions",
        ),
        "loro_poisson": _query(
            f"SELECT district, {_SCORES.format(r=_PEARSON)} FROM fold_poisson GROUP BY district",
            "fold_poisson",
        ),
        "residuals_by_segment": _query(
            "SELECT ogf_id, crash_count, round(prediction, 6) AS prediction,"
            " round(crash_count - prediction, 6) AS residual FROM predictions",
            "predictions",
        ),
        "regression_metrics": _query(f"SELECT {_SCORES.format(r='')} FROM predictions", "predictions"),
        "metrics_by_region": _query(
            f"SELECT district, {_SCORES.format(r=_PEARSON)} FROM predictions"
            " WHERE district IS NOT NULL GROUP BY district",
            "predictions",
        ),
        "residual_histogram": _query(
            "SELECT b.bin, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper,"
            " count(p.ogf_id) AS n FROM bins b LEFT JOIN predictions p"
            " ON crash_count - prediction >= b.lower"
            " AND (crash_count - prediction < b.upper OR (b.bin = 29 AND crash_count - prediction <= b.upper))"
            " GROUP BY ALL",
            "bins",
            "predictions",
        ),
        "pred_vs_actual_summary": _query(
            "SELECT crash_count, round(prediction, 6) AS predicted, count(*) AS n,"
            " (SELECT min(crash_count) FROM predictions) AS label_min,"
            " (SELECT max(crash_count) FROM predictions) AS label_max FROM predictions GROUP BY 1, 2",
            "predictions",
        ),
        "loro_cell_mean": _query(
            f"SELECT district, {_SCORES.format(r=_PEARSON)} FROM fold_predictions GROUP BY district",
            "fold_predictions",
        ),
    }
