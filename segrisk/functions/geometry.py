"""Polylines as rows of straight parts, and the square grid cells a part can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.functions.projection import (
    DEFAULT_ZONE,
    MAX_OFF_MERIDIAN,
    ZONE_STEP,
    central_meridian,
    has_coordinates,
    not_null,
    with_utm,
    zone_of,
)

# Metres added to the radius when cells are chosen, so that rounding can never hide a cell.
_SLACK = 1e-3

# Parts narrower than this many metres count as vertical: their slope would amplify rounding errors.
_VERTICAL = 1.0

# Coordinates beyond this many metres, in the range of any zone, do not lie on the globe.
_WORLD = 5e7 + 60 * ZONE_STEP

# Columns of a part with its direction.
PART = ["x1", "y1", "ux", "uy", "length"]


def line_parts(
    segments: DataFrame, keys: list[str], zone: int | None = DEFAULT_ZONE, radius: float = 0.0
) -> DataFrame:
    """One row per two-vertex part of every polyline: ``keys``, its ends (x1, y1) and (x2, y2) in metres.

    Without a ``zone`` each part is projected in the zones that it, widened by ``radius`` metres, lies in, once for each.
    With one, a part far away from it raises, because distances would be wrong there.

    Vertices are paired by zipping the vertex list with itself shifted by one. Lines with fewer than two
    vertices and vertices without coordinates yield no part; a null geometry yields none either.
    """
    pairs = "arrays_zip(slice(_line, 1, size(_line) - 1), slice(_line, 2, size(_line) - 1))"
    ends = ["_a.x AS _lon1", "_a.y AS _lat1", "_b.x AS _lon2", "_b.y AS _lat2"]
    parts = (
        segments.selectExpr(*keys, "explode(lines) AS _line")
        .where("size(_line) >= 2")
        .selectExpr(*keys, f"inline({pairs}) AS (_a, _b)")
        .selectExpr(*keys, *ends)
        .where(f"{has_coordinates('_lon1', '_lat1')} AND {has_coordinates('_lon2', '_lat2')}")
    )
    if zone is None:
        # Degrees of longitude that the radius takes at the latitude nearest to a pole; a degree is 111 km at the equator.
        margin = f"{radius * 1.01 + 1.0}D / (110574D * greatest(cos(radians(greatest(abs(_lat1), abs(_lat2)))), 1e-6D))"
        west = zone_of(f"greatest(least(_lon1, _lon2) - {margin}, -180D)")
        east = zone_of(f"least(greatest(_lon1, _lon2) + {margin}, 180D)")
        parts = parts.selectExpr("*", f"explode(sequence({west}, {east})) AS _zone")
    else:
        meridian = central_meridian(zone)
        wrong = f"raise_error(concat('longitude ', _lon1, ' is not near UTM zone {zone}; use zone=None for all zones'))"
        far = f"greatest(abs(_lon1 - {meridian}D), abs(_lon2 - {meridian}D)) > {MAX_OFF_MERIDIAN}D"
        parts = parts.withColumn("_lon1", F.expr(f"CASE WHEN {far} THEN CAST({wrong} AS DOUBLE) ELSE _lon1 END"))
    own = "_zone" if zone is None else zone
    projected = with_utm(parts, ("_lon1", "_lat1", "x1", "y1"), ("_lon2", "_lat2", "x2", "y2"), zone=own)
    return projected.select(*keys, "x1", "y1", "x2", "y2")


def cell_of(coordinate: str, cell: float) -> str:
    """Grid index of a coordinate, never null (see ``with_utm``)."""
    return f"coalesce(floor({coordinate} / {float(cell)}D), 0L)"


def with_cells(parts: DataFrame, radius: float, cell: float) -> DataFrame:
    """One row per part and grid cell (cx, cy) that may hold a point within ``radius`` of the part.

    The part is cut into grid columns first and only the rows it crosses in each column are listed, so a
    diagonal part of length L costs about L / cell cells, not the square of that.
    """
    reach, size = f"{radius + _SLACK}D", f"{float(cell)}D"

    def indices(start: str, stop: str) -> str:
        return f"sequence(floor(({start} - {reach}) / {size}), floor(({stop} + {reach}) / {size}))"

    on_globe = f"greatest(abs(x1), abs(y1), abs(x2), abs(y2)) < {_WORLD}D"
    columns = f"CASE WHEN {on_globe} THEN {indices('least(x1, x2)', 'greatest(x1, x2)')} END"
    # y at the two borders of the column, which is widened by the radius, but not beyond the ends of the part.
    slope = f"CASE WHEN abs(x2 - x1) >= {_VERTICAL}D THEN (y2 - y1) / (x2 - x1) END"
    enter = f"coalesce(y1 + _slope * (greatest(least(x1, x2), cx * {size} - {reach}) - x1), y1)"
    leave = f"coalesce(y1 + _slope * (least(greatest(x1, x2), (cx + 1) * {size} + {reach}) - x1), y2)"
    return (
        parts.selectExpr("*", f"{slope} AS _slope", f"explode({columns}) AS cx")
        .selectExpr("*", f"{enter} AS _enter", f"{leave} AS _leave")
        .selectExpr("*", f"explode({indices('least(_enter, _leave)', 'greatest(_enter, _leave)')}) AS cy")
        .drop("_slope", "_enter", "_leave")
    )


def with_direction(parts: DataFrame) -> DataFrame:
    """The part as start (x1, y1), unit direction (ux, uy) and length; a part without length points east."""
    ux = not_null("CASE WHEN length > 0 THEN (x2 - x1) / length ELSE 1D END")
    uy = not_null("CASE WHEN length > 0 THEN (y2 - y1) / length ELSE 0D END")
    return (
        parts.selectExpr("*", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length")
        .selectExpr("*", f"{ux} AS ux", f"{uy} AS uy")
        .drop("x2", "y2")
    )


def quartered(parts: DataFrame, radius: float, cell: float) -> DataFrame:
    """Rows of ``with_direction`` moved from cells of twice the size to those of their four quarters that they reach."""
    reach, size = f"{radius + _SLACK}D", f"{float(cell)}D"
    ends = ["x1 + ux * length AS _x2", "y1 + uy * length AS _y2", "cx AS _pcx", "cy AS _pcy"]
    slope = f"CASE WHEN abs(_x2 - x1) >= {_VERTICAL}D THEN (_y2 - y1) / (_x2 - x1) END"
    enter = f"coalesce(y1 + _slope * (greatest(least(x1, _x2), cx * {size} - {reach}) - x1), y1)"
    leave = f"coalesce(y1 + _slope * (least(greatest(x1, _x2), (cx + 1) * {size} + {reach}) - x1), _y2)"

    def overlaps(low: str, high: str, index: str) -> str:
        """The range, widened by the radius, has a point in the row or column of cells."""
        return f"({low}) - {reach} < ({index} + 1) * {size} AND ({high}) + {reach} >= {index} * {size}"

    return (
        parts.selectExpr(*(c for c in parts.columns if c not in ("cx", "cy")), *ends)
        .selectExpr("*", f"{slope} AS _slope", "explode(array(2 * _pcx, 2 * _pcx + 1)) AS cx")
        .where(overlaps("least(x1, _x2)", "greatest(x1, _x2)", "cx"))
        .selectExpr("*", f"{enter} AS _enter", f"{leave} AS _leave", "explode(array(2 * _pcy, 2 * _pcy + 1)) AS cy")
        .where(overlaps("least(_enter, _leave)", "greatest(_enter, _leave)", "cy"))
        .select(*parts.columns)
    )


def within(radius: float, x: str = "_x", y: str = "_y", part: str = "{}") -> str:
    """Condition that point (x, y) is closer than ``radius`` to the part in the same row, whose columns ``part`` names.

    Works in the part's own axes: the offset across its line, and the overshoot past its nearer end. Plain
    products and comparisons only, the one that most rows fail first, because this runs for every candidate pair.
    """
    x1, y1, ux, uy, length = (part.format(c) for c in PART)
    along = f"(({x} - {x1}) * {ux} + ({y} - {y1}) * {uy})"
    across = f"(({x} - {x1}) * {uy} - ({y} - {y1}) * {ux})"
    beyond = f"(CASE WHEN {along} < 0D THEN -{along} ELSE {along} - {length} END)"
    limit = f"{float(radius) ** 2}D"
    beside = f"({along} >= 0D AND {along} <= {length})"
    past = f"({across} * {across} + {beyond} * {beyond} < {limit})"
    return f"({across} * {across} < {limit} AND ({beside} OR {past}))"
