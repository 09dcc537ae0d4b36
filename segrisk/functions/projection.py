"""Geographic coordinates and their transverse Mercator (UTM) projection as native columns.

Formulas are written as SQL expressions: they read like the formulas, and the driver sends each as one text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

GEOGRAPHIC = "EPSG:4326"
DEFAULT_ZONE = 17

# Metres between the eastings of neighbouring zones where several are used together: far beyond any easting of a zone,
# and a power of 2, so that grid cells fall alike in every zone.
ZONE_STEP = float(2**27)

# Degrees from the central meridian of a zone beyond which lines cannot be projected in it with useful accuracy.
MAX_OFF_MERIDIAN = 9.0

# WGS84 ellipsoid and the UTM convention.
SEMI_MAJOR_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0

# Krueger series in the third flattening, cut after the third order (well below 1 mm inside a zone).
_N = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR_AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def assert_geographic(crs: str | None) -> str:
    """Undeclared means lon/lat; any other declared system is an error, never a silent relabelling."""
    if crs is None:
        return GEOGRAPHIC
    if crs.upper() != GEOGRAPHIC:
        raise ValueError(f"coordinates must be geographic lon/lat ({GEOGRAPHIC}), got {crs}")
    return GEOGRAPHIC


def central_meridian(zone: int) -> float:
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM zones run from 1 to 60, got {zone}")
    return zone * 6.0 - 183.0


def has_coordinates(lon: str, lat: str) -> str:
    """Condition for usable coordinates. Ranges are false for NULL and NaN and reach the scan as pushed filters."""
    return (
        f"({lon} IS NOT NULL AND {lat} IS NOT NULL"
        f" AND {lon} >= -180D AND {lon} <= 180D AND {lat} >= -90D AND {lat} <= 90D)"
    )


def not_null(value: str) -> str:
    """``value`` with NULL replaced by NaN, which no distance test accepts."""
    return f"coalesce({value}, double('NaN'))"


def zone_of(lon: str) -> str:
    """The UTM zone of a longitude from -180 to 180."""
    return f"least(CAST(floor(({lon} + 180D) / 6) AS INT) + 1, 60)"


def with_utm(df: DataFrame, *points: tuple[str, str, str, str], zone: int | str = DEFAULT_ZONE) -> DataFrame:
    """Add easting and northing in metres of the northern UTM ``zone`` for each (lon, lat, x, y) of column names.

    ``zone`` is a number, or the name of a column with the zone of each row. In the latter case every zone has its own
    range of eastings, ``ZONE_STEP`` apart, so that positions in different zones are never near each other.

    The intermediate values are columns of their own, so each is computed once per row. The results are NaN, never
    NULL: for a nullable column every later join would push a null check, and with it the whole formula, down to
    the scan a second time.
    """
    own = isinstance(zone, str)
    meridian = f"({zone} * 6D - 183D)" if own else f"{central_meridian(zone)}D"
    shift = f" + ({zone} - {DEFAULT_ZONE}) * {ZONE_STEP}D" if own else ""
    conformal, sphere, plane, helpers = [], [], [], []
    for i, (lon, lat, x, y) in enumerate(points):
        t, xi, eta = f"_t{i}", f"_xi{i}", f"_eta{i}"
        helpers += [t, xi, eta]
        phi, delta = f"radians({lat})", f"radians({lon} - {meridian})"
        e = f"{ECCENTRICITY!r}D"
        conformal.append(f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi}))) AS {t}")
        sphere.append(f"atan2({t}, cos({delta})) AS {xi}")
        sphere.append(f"atanh(sin({delta}) / sqrt(1 + {t} * {t})) AS {eta}")
        east, north = eta, xi
        for order, alpha in enumerate(ALPHA, start=1):
            k = 2 * order
            east += f" + {alpha!r}D * cos({k} * {xi}) * sinh({k} * {eta})"
            north += f" + {alpha!r}D * sin({k} * {xi}) * cosh({k} * {eta})"
        scale = f"{SCALE * RECTIFYING_RADIUS!r}D"
        plane.append(f"{not_null(f'{FALSE_EASTING}D + {scale} * ({east}){shift}')} AS {x}")
        plane.append(f"{not_null(f'{scale} * ({north})')} AS {y}")
    return df.selectExpr("*", *conformal).selectExpr("*", *sphere).selectExpr("*", *plane).drop(*helpers)
