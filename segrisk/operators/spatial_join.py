"""Crashes within a distance of road segments: a grid equi-join with an exact distance test.

A point lies in exactly one square grid cell, and a straight part of a segment is listed in every cell that may
hold a point near it. Joining on the cell leaves few candidates, which the join condition tests by distance.
The result does not depend on the cell size.

Zones. By default everything is projected in one UTM zone, and segments far from it raise. With ``zone=None`` a point
counts in its own zone, and a part is repeated in a neighbouring zone if it comes within the radius of the border.

Skew. Points at one position are counted into one row, and copies of one geometry into one row, before anything
is shuffled by cell. The grid is hierarchical: cells that still hold many points or parts are cut into quarters,
level by level, and points and parts of such a cell move on to its quarters, by a plain join with the list of crowded
cells. That list has at most one row per ``BLOCK_ROWS`` rows of input. Only what quarters cannot separate, because it
lies in one place, is cut into blocks: points over ``_i``, parts over ``_j``, each side repeated for the blocks that
the other side has in this cell, never for those of other cells.

Dense networks. The number of pairs grows with the product of both sides, so counts never hold pairs: the parts that a
segment has in a cell are one row, a point meets it once, and the hits are added up as the join finds them. For sums
of many kinds, cells are shuffled by tiles of neighbouring cells, so that most cells of a segment are added up in one
task. Pairs that are asked for leave the join as they are found: they are distinct unless a cell has several points of
one key, and only pairs of such keys are held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from segrisk.functions.geometry import PART, cell_of, line_parts, quartered, with_cells, with_direction, within
from segrisk.functions.missing import as_double
from segrisk.functions.projection import DEFAULT_ZONE, assert_geographic, has_coordinates, not_null, with_utm, zone_of
from segrisk.operators.features import COPIES, require_columns, with_copies
from segrisk.operators.joins import join_by_id
from segrisk.session import materialise, materialise_all

RADIUS = 10.0
CELL = 32.0

# Rows of one side of a cell above which the cell is split, and how often it may be quartered before it is cut.
BLOCK_ROWS = 50_000
LEVELS = 2

# Parts of a segment in a cell that have columns of their own; more are held in an array, which is slower to test.
OWN_PARTS = 3

# Cells along a side of a tile, as a power of 2.
TILE_BITS = 3

_CELL = ["cx", "cy"]
_LEAF = ["_level", "cx", "cy", "_i", "_j"]


def _crowded_cells(points: DataFrame, parts: DataFrame, block_rows: int) -> DataFrame:
    """Cells with more than ``block_rows`` rows on a side, and the number of rows of both sides."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = points.select(*_CELL, one.alias("_p"), none.alias("_s")).unionByName(
        parts.select(*_CELL, none.alias("_p"), one.alias("_s"))
    )
    loads = rows.groupBy(*_CELL).agg(F.sum("_p").alias("_points"), F.sum("_s").alias("_parts"))
    return loads.where(F.greatest("_points", "_parts") > block_rows)


def _leaves(
    points: DataFrame,
    point_key: list[str],
    parts: DataFrame,
    segment_key: list[str],
    radius: float,
    cell: float,
    block_rows: int,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cell that each row ends up in, and the columns that name the cell."""
    crowded = _crowded_cells(points, parts, block_rows)
    if crowded.isEmpty():
        return points, parts, _CELL
    kept: list[tuple[DataFrame, DataFrame]] = []

    def keep(side: DataFrame, level: int) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return side.withColumns({"_level": F.lit(level), "_i": zero, "_j": zero})

    for level in range(LEVELS + 1):
        crowded = materialise(crowded, "crowded_cells")
        names = crowded.select(*_CELL)
        kept.append(tuple(keep(side.join(names, _CELL, "left_anti"), level) for side in (points, parts)))
        points, parts = (side.join(names, _CELL, "left_semi") for side in (points, parts))
        if level == LEVELS:
            break
        cell /= 2
        x, y = f"{cell_of('_x', cell)} AS cx", f"{cell_of('_y', cell)} AS cy"
        points = materialise(points.selectExpr(*point_key, "_x", "_y", x, y), "quartered_points")
        parts = materialise(quartered(parts, radius, cell), "quartered_parts")
        crowded = _crowded_cells(points, parts, block_rows)
    blocks = crowded.selectExpr(
        *_CELL, *(f"greatest(ceil({n} / {block_rows}), 1L) AS {b}" for n, b in (("_points", "_bi"), ("_parts", "_bj")))
    )

    def cut(side: DataFrame, key: list[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        # The block comes from the row's key, so it is the same in every run, and one for all parts of a segment.
        number = F.pmod(F.xxhash64(*key), F.col(own[1])).alias(own[0])
        repeated = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other[1]) - 1)).alias(other[0])
        rows = side.join(blocks, _CELL)
        return rows.select(*side.columns, F.lit(LEVELS).alias("_level"), number, repeated)

    kept.append((cut(points, point_key, ("_i", "_bi"), ("_j", "_bj")), cut(parts, segment_key, ("_j", "_bj"), ("_i", "_bi"))))
    points, parts = (reduce(DataFrame.unionByName, sides) for sides in zip(*kept, strict=True))
    return points, parts, _LEAF


def _dealt(rows: DataFrame, cells: list[str], by_tile: bool) -> tuple[DataFrame, list[str], list[str]]:
    """Rows dealt out by cell, or by its tile; the columns they are dealt by, and all that name the cell.

    Crowded cells have smaller tiles.
    """
    if not by_tile:
        return rows.repartition(*cells), cells, cells
    tiles = {"_tx": F.shiftright("cx", TILE_BITS), "_ty": F.shiftright("cy", TILE_BITS)}
    names = [*tiles, *(c for c in cells if c not in _CELL)]
    return rows.withColumns(tiles).repartition(*names), names, [*dict.fromkeys([*names, *cells])]


def _repeated(points: DataFrame, point_key: list[str]) -> DataFrame:
    """Keys that several rows of a cell have."""
    return points.groupBy(*_CELL, *point_key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")


def _by_repeats(points: DataFrame, point_key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is the only one of its kind in its cell, and the others, if there are any."""
    if _repeated(points, point_key).isEmpty():
        return points, None
    points = materialise(points.distinct(), "distinct_points")
    repeated = materialise(_repeated(points, point_key), "repeated_keys")
    if repeated.isEmpty():
        return points, None
    names = [*_CELL, *point_key]
    same = reduce(lambda x, y: x & y, (F.col(f"p.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names))
    alone, others = (points.alias("p").join(repeated.alias("r"), same, how) for how in ("left_anti", "left_semi"))
    return materialise(alone, "points_alone"), materialise(others, "points_of_repeated_keys")


def _near(
    points: DataFrame,
    point_key: list[str],
    segments: DataFrame,
    segment_key: list[str],
    radius: float,
    cell: float,
    zone: int | None,
    block_rows: int,
    *,
    by_tile: bool = False,
    keys_repeat: bool = False,
) -> tuple[list[DataFrame], list[str]]:
    """Pairs of a point row and a segment that are near each other, and the columns they are dealt out by.

    The tables have disjoint pairs, with the columns of their cell, ``point_key`` and ``segment_key``. A row of
    ``points`` and a segment meet in one cell, because a point has one cell and the block of a part depends on
    ``segment_key`` only, and there the parts of the segment are one row. With ``keys_repeat``, several rows of
    ``points`` may have one key, and those of a cell count as one; only pairs of such keys are made distinct.

    ``by_tile`` keeps the cells of a tile in one task, for sums, in sessions where ``ALL_JOIN_KEYS`` is off; in others
    the result is the same, and more rows are shuffled.
    """
    if zone is None:
        points = points.selectExpr("*", f"{zone_of('longitude')} AS _zone")
    own = "_zone" if zone is None else zone
    located = with_utm(points, ("longitude", "latitude", "_x", "_y"), zone=own).selectExpr(
        *point_key, "_x", "_y", f"{cell_of('_x', cell)} AS cx", f"{cell_of('_y', cell)} AS cy"
    )
    parts = with_direction(with_cells(line_parts(segments, segment_key, zone, radius), radius, cell))
    # Written once in narrow rows, side by side: counting the cells and joining them both read them.
    located, parts = materialise_all(points=located, parts=parts)
    located, others = _by_repeats(located, point_key) if keys_repeat else (located, None)
    if others is not None:
        # Both are split alike, so that a crowded cell has the same leaves for both.
        located = located.withColumn("_alone", F.lit(True)).unionByName(others.withColumn("_alone", F.lit(False)))
    more = [] if others is None else ["_alone"]
    located, parts, cells = _leaves(located, [*point_key, *more], parts, segment_key, radius, cell, block_rows)
    # Columns of a table read back may be NULL for the planner; the distance test is shorter for those that cannot.
    located = located.withColumns({c: F.expr(not_null(c)) for c in ("_x", "_y")})
    located, _, _ = _dealt(located, cells, by_tile)
    parts, dealt, names = _dealt(parts, cells, by_tile)
    # Inside the partitions of the join.
    grouped = parts.groupBy(*names, *segment_key).agg(F.collect_list(F.struct(*PART)).alias("_parts"))
    size = F.size("_parts").alias("_n")
    columns = [
        F.coalesce(F.get("_parts", F.lit(i))[c], F.lit(0.0)).alias(f"{c}_{i}") for i in range(OWN_PARTS) for c in PART
    ]
    few = grouped.where(size <= OWN_PARTS).select(*names, *segment_key, size, *columns)
    any_of_few = " OR ".join(f"_n > {i} AND {within(radius, part=f'{{}}_{i}')}" for i in range(OWN_PARTS))
    many = grouped.where(size > OWN_PARTS)
    any_of_many = f"exists(_parts, part -> {within(radius, part='part.{}')})"

    def meet(points: DataFrame, sides: DataFrame, near: str) -> DataFrame:
        same_cell = " AND ".join(f"p.{k} = s.{k}" for k in names)
        # A merge join, because the planner's size estimate does not see how many hits a cell has. It holds the points
        # of a cell, which are the narrower rows.
        pairs = sides.alias("s").join(points.alias("p").hint("merge"), F.expr(f"{same_cell} AND ({near})"))
        return pairs.selectExpr(*(f"p.{k}" for k in names), *point_key, *segment_key)

    sides = [(few, any_of_few), (many, any_of_many)]
    if others is None:
        return [meet(located, *side) for side in sides], dealt
    alone, others = located.where("_alone"), located.where("NOT _alone")
    # The columns include those the rows are dealt by, so this runs in the join's own partitions.
    return [pairs for side in sides for pairs in (meet(alone, *side), meet(others, *side).distinct())], dealt


def located_crashes(crashes: DataFrame) -> DataFrame:
    """Crashes with both coordinates on the globe; only they can be near a segment."""
    return crashes.where(has_coordinates("longitude", "latitude"))


def spatial_join_pairs(
    crashes: DataFrame,
    segments: DataFrame,
    *,
    crash_key: str = "crash_id",
    segment_key: str = "ogf_id",
    radius: float = RADIUS,
    cell: float = CELL,
    zone: int | None = DEFAULT_ZONE,
    crs: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every (crash, segment) pair closer than ``radius`` metres, once. The boundary itself is outside."""
    assert_geographic(crs)
    require_columns(crashes, crash_key, "longitude", "latitude")
    require_columns(segments, segment_key, "lines")
    points = located_crashes(crashes).select(crash_key, "longitude", "latitude")
    geometries = segments.select(segment_key, "lines").distinct()
    # Crashes of one id in one cell are one. Pairs of other ids leave the join as they are found, so none are held.
    near, _ = _near(
        points, [crash_key], geometries, [segment_key], radius, cell, zone, block_rows, keys_repeat=True
    )
    return reduce(DataFrame.unionByName, near).select(crash_key, segment_key)


def unmatched_crashes(
    crashes: DataFrame,
    segments: DataFrame,
    *,
    keep_missing: bool = False,
    radius: float = RADIUS,
    cell: float = CELL,
    zone: int | None = DEFAULT_ZONE,
    crs: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Crashes near no segment; those without coordinates only with ``keep_missing``.

    Positions decide, so crashes need no id. Coordinates that lie nowhere on the globe are near no segment.
    """
    assert_geographic(crs)
    require_columns(crashes, "longitude", "latitude")
    require_columns(segments, "ogf_id", "lines")
    key = ["longitude", "latitude"]
    positions = located_crashes(crashes).select(*key).distinct()
    geometries = segments.select("lines").distinct().withColumn("_shape", F.xxhash64("lines"))
    near, dealt = _near(positions, key, geometries, ["_shape"], radius, cell, zone, block_rows)
    # One row per position, made inside the join's own partitions.
    near = [pairs.select(*dealt, *key).distinct().select(*key).toDF("_lon", "_lat") for pairs in near]
    near = reduce(DataFrame.unionByName, near)
    missing = as_double("longitude").isNull() | as_double("latitude").isNull()
    candidates = crashes if keep_missing else crashes.where(~missing)
    return candidates.join(near, F.expr("longitude = _lon AND latitude = _lat"), "left_anti")


def crash_counts(
    segments: DataFrame,
    crashes: DataFrame,
    *,
    mode: str = "rows",
    radius: float = RADIUS,
    cell: float = CELL,
    zone: int | None = DEFAULT_ZONE,
    crs: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``crash_count`` per ``ogf_id`` that has any.

    ``mode="rows"`` counts a crash once for every segment row near it, so fan-out rows multiply the count;
    ``mode="segments"`` counts it once per id. Crashes near several segments count for each of them.
    """
    if mode not in ("rows", "segments"):
        raise ValueError(f"mode must be 'rows' or 'segments', got {mode!r}")
    assert_geographic(crs)
    require_columns(segments, "ogf_id", "lines")
    require_columns(crashes, "longitude", "latitude")
    positions = (
        located_crashes(crashes).groupBy("longitude", "latitude").agg(F.count(F.lit(1)).alias("_crashes"))
    )
    known = with_copies(segments).where(F.col("ogf_id").isNotNull())
    position_key = ["longitude", "latitude", "_crashes"]
    if mode == "rows":
        geometries = (
            known.groupBy("ogf_id", "lines")
            .agg(F.sum(COPIES).alias("_rows"))
            # Tells the geometries of one id apart without carrying them through the join.
            .withColumn("_shape", F.xxhash64("lines"))
        )
        segment_key, weight = ["ogf_id", "_shape", "_rows"], F.col("_crashes") * F.col("_rows")
    else:
        geometries = known.select("ogf_id", "lines").distinct()
        segment_key, weight = ["ogf_id"], F.col("_crashes")
    near, _ = _near(positions, position_key, geometries, segment_key, radius, cell, zone, block_rows)
    # Positions are distinct, so is every pair; hits are added up inside the join's own partitions first.
    return reduce(DataFrame.unionByName, near).groupBy("ogf_id").agg(F.sum(weight).alias("crash_count"))


CUBE = ["hour", "weather"]

# Hours that are counted in columns of one row.
SLOTS = 24


def crash_counts_cube(
    segments: DataFrame,
    crashes: DataFrame,
    *,
    radius: float = RADIUS,
    cell: float = CELL,
    zone: int | None = DEFAULT_ZONE,
    crs: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Crashes per segment by hour and weather, by either, and in all, from one spatial join.

    ``crashes`` has a weather and an hour (see ``crash_datetime``). Where ``all_hours`` or ``all_weather`` is true, the
    row is the sum over that column, which is NULL then; a NULL without it is a missing value. Every filter by hours
    and weather is a sum over rows of the finest level (``counts_of``).
    """
    assert_geographic(crs)
    require_columns(segments, "ogf_id", "lines")
    require_columns(crashes, "longitude", "latitude", *CUBE)
    positions = located_crashes(crashes).groupBy("longitude", "latitude", *CUBE).agg(F.count(F.lit(1)).alias("_crashes"))
    geometries = segments.where(F.col("ogf_id").isNotNull()).select("ogf_id", "lines").distinct()
    # Hours are counted in the columns of a row, one for each of a run of SLOTS hours that begins with _first. A missing
    # hour is a run of its own, as is any value of a type that is not one of small whole numbers.
    hour = positions.schema["hour"].dataType
    counted = isinstance(hour, ByteType | ShortType | IntegerType)
    slots = [f"_n{i}" for i in range(SLOTS if counted else 1)]
    slot = f"pmod(CAST(hour AS BIGINT), {SLOTS}L)" if counted else "0L"
    first = f"CAST(hour AS BIGINT) - {slot}" if counted else "hour"
    positions = positions.withColumns({"_first": F.expr(first), "_slot": F.expr(f"coalesce({slot}, 0L)")})
    key = ["longitude", "latitude", "weather", "_first", "_slot", "_crashes"]
    near, dealt = _near(positions, key, geometries, ["ogf_id"], radius, cell, zone, block_rows, by_tile=True)
    # Summed up per segment, weather and run inside the join's own partitions, then once per segment, where all levels
    # are made: only these rows are shuffled, once.
    hits = [F.sum(F.expr(f"CASE WHEN _slot = {i} THEN _crashes END")).alias(n) for i, n in enumerate(slots)]
    runs = ["weather", "_first"]
    summed = [pairs.groupBy(*dealt, "ogf_id", *runs).agg(*hits) for pairs in near]
    summed = reduce(DataFrame.unionByName, summed).select("ogf_id", *runs, *slots).repartition("ogf_id")
    levels = [
        F.struct(F.when(F.lit(not every), F.col("weather")).alias("weather"), F.lit(every).alias("all_weather"))
        for every in (False, True)
    ]
    by_weather = ["ogf_id", "weather", "all_weather"]
    repeated = summed.select("ogf_id", "_first", *slots, F.inline(F.array(*levels)))
    rows = repeated.groupBy(*by_weather, "_first").agg(*(F.sum(n).alias(n) for n in slots))
    hours = [
        F.struct(
            (F.col("_first") + i).try_cast(hour).alias("hour") if counted else F.col("_first").alias("hour"),
            F.lit(False).alias("all_hours"),
            F.col(n).alias("crash_count"),
        )
        for i, n in enumerate(slots)
    ]
    per_hour = rows.select(*by_weather, F.inline(F.array(*hours))).where("crash_count IS NOT NULL")
    total = reduce(lambda x, y: x + y, (F.coalesce(n, F.lit(0).cast("bigint")) for n in slots))
    in_all = rows.groupBy(*by_weather).agg(F.sum(total).alias("crash_count"))
    in_all = in_all.select("*", F.lit(None).cast(hour).alias("hour"), F.lit(True).alias("all_hours"))
    columns = ["ogf_id", *CUBE, "all_hours", "all_weather", "crash_count"]
    return per_hour.select(*columns).unionByName(in_all.select(*columns))


def counts_of(cube: DataFrame, hours: tuple[int, int] | None = None, weather: tuple[str, ...] | None = None) -> DataFrame:
    """``crash_count`` per segment within the hours (both included) and the kinds of weather, from a cube."""
    rows = cube.where((F.col("all_hours") == (hours is None)) & (F.col("all_weather") == (weather is None)))
    if hours is not None:
        rows = rows.where(F.col("hour").between(*hours))
    if weather is not None:
        rows = rows.where(F.col("weather").isin(*weather))
    return rows.groupBy("ogf_id").agg(F.sum("crash_count").alias("crash_count"))


def with_crash_counts(segments: DataFrame, crashes: DataFrame, **options) -> DataFrame:
    """``segments`` with ``crash_count``; 0 where no crash is near."""
    counted = join_by_id(segments, crash_counts(segments, crashes, **options), "ogf_id")
    return counted.withColumn("crash_count", F.coalesce("crash_count", F.lit(0).cast("bigint")))


def segments_with_crashes(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("crash_count") > 0)


def segments_with_crashes_total(segments: DataFrame) -> DataFrame:
    """Number of rows and of distinct segments with at least one crash."""
    hit = segments_with_crashes(with_copies(segments))
    # One row per id first: the ids themselves never meet in a single task.
    per_segment = hit.groupBy("ogf_id").agg(F.sum(COPIES).alias("_rows"))
    return per_segment.agg(
        F.coalesce(F.sum("_rows"), F.lit(0).cast("bigint")).alias("n_rows"),
        F.count("ogf_id").alias("n_segments"),
    )


def top_crash_segments(segments: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` segments with most crashes; equal counts are ordered by id."""
    return (
        segments.groupBy("ogf_id")
        .agg(F.max("crash_count").alias("crash_count"))
        .where(F.col("crash_count") > 0)
        .orderBy(F.desc("crash_count"), "ogf_id")
        .limit(n)
    )
