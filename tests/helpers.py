"""Independent numpy versions of the geometry, and small builders."""

import math

import numpy as np

from segrisk.schemas import ROADS

A, F = 6378137.0, 1 / 298.257223563


def utm(lon, lat, zone=17):
    """Snyder's series for the transverse Mercator projection, unlike the one under test."""
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    e2 = F * (2 - F)
    ep2 = e2 / (1 - e2)
    n = A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    t, c = np.tan(lat) ** 2, ep2 * np.cos(lat) ** 2
    a = (lon - math.radians(zone * 6 - 183)) * np.cos(lat)
    m = A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * lat)
        - (35 * e2**3 / 3072) * np.sin(6 * lat)
    )
    east = a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120
    north = m + n * np.tan(lat) * (
        a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720
    )
    return 500000 + 0.9996 * n * east, 0.9996 * north


def distance(px, py, x1, y1, x2, y2):
    """Distance of points to one straight part."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / length2, 0, 1) if length2 else np.zeros_like(px)
    return np.hypot(px - x1 - t * dx, py - y1 - t * dy)


def brute_force_pairs(crashes, roads, radius=10.0, zone=17):
    """{(crash_id, ogf_id)} by testing everything against everything."""
    located = [c for c in crashes if c[1] is not None and c[2] is not None and not math.isnan(c[1])]
    ids = [c[0] for c in located]
    px, py = utm([c[1] for c in located], [c[2] for c in located], zone)
    pairs = set()
    for ogf_id, lines, _ in roads:
        for line in lines or []:
            vx, vy = utm([v[0] for v in line], [v[1] for v in line], zone)
            for i in range(len(line) - 1):
                near = distance(px, py, vx[i], vy[i], vx[i + 1], vy[i + 1]) < radius
                pairs |= {(ids[j], ogf_id) for j in np.flatnonzero(near)}
    return pairs


def roads_df(spark, roads):
    return spark.createDataFrame(roads, ROADS)


def crashes_df(spark, crashes):
    return spark.createDataFrame(crashes, "crash_id long, longitude double, latitude double")


def random_network(seed, n_roads=60, n_crashes=600, box=0.01):
    """Bent and multi-part polylines, and crashes that cluster around their vertices."""
    rng = np.random.default_rng(seed)
    roads, vertices = [], []
    for i in range(n_roads):
        lines = []
        for _ in range(rng.integers(1, 3)):
            start = rng.uniform([-79.40, 43.65], [-79.40 + box, 43.65 + box])
            steps = rng.normal(0, box / 20, (rng.integers(1, 6), 2))
            line = np.vstack([start, start + np.cumsum(steps, axis=0)])
            lines.append([(float(x), float(y)) for x, y in line])
            vertices.append(line)
        roads.append((i, lines, None))
    around = np.vstack(vertices)
    chosen = around[rng.integers(0, len(around), n_crashes)] + rng.normal(0, 1e-4, (n_crashes, 2))
    crashes = [(i, float(x), float(y)) for i, (x, y) in enumerate(chosen)]
    return roads, crashes
