"""Hard negatives against a search of all pairs, with ties, hot vectors, odd rows and small blocks."""

import math
import random

import numpy as np
import pytest

from segrisk.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, slot int, anchor string"


def brute_force(rows, every=100, n_positives=5, n_negatives=10, relabel=7):
    own = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        values = [math.floor(256 * float(np.float32(x))) for x in vector]
        own.append((vec_id, (label + 1) % 10 if relabel and vec_id % relabel == 0 else label, values))
    anchors = {}
    for vec_id, label, v in sorted(own):
        if vec_id % every == 0:
            anchors.setdefault(vec_id, (label, v))
    out = []
    for anchor, (label, v) in anchors.items():
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i, same == label)
            for i, same, w in own
            if i != anchor and len(w) == len(v)
        )
        for positive, positive_id, _ in [s for s in scored if s[2]][:n_positives]:
            fitting = [s for s in scored if not s[2] and 30 * -positive <= 100 * -s[0] <= 90 * -positive][:n_negatives]
            out += [(anchor, positive_id, r, i, -positive, -s) for r, (s, i, _) in enumerate(fitting, 1)]
    return sorted(out)


def found(spark, rows, parts=3, rule=None):
    table = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, negatives.hard_negatives(negatives.usable_rows(table, 7), rule).collect()))


def random_rows(seed, n, width, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [
        (i, [c + rng.choice([0, 0.25, -0.5, rng.gauss(0, spread)]) for c in centres[label]], label)
        for i in range(n)
        for label in [rng.randrange(4)]
    ]


@pytest.mark.parametrize("block, tile", [(32_768, 512), (2, 3)])
def test_equals_all_pairs(spark, monkeypatch, block, tile):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", tile)
    monkeypatch.setattr(negatives, "TILE_ROWS", 10 * tile)
    rows = random_rows(1, 700, 6, 0.8)
    want = brute_force(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_hot_vectors_and_repeated_rows(spark):
    rows = random_rows(2, 400, 4, 0.5)
    hot = [(1000 + i, rows[5][1], 2) for i in range(300)] + [(2000 + i, rows[6][1], 1) for i in range(300)]
    rows += [*hot, *hot[:20], rows[8], rows[100], rows[200], rows[200]]
    assert found(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(3, 301, 3, 0.6)
    rows += [
        (None, [1.0, 1.0, 1.0], 1), (1100, None, 1), (1200, [1.0, None, 1.0], 1), (1300, [nan, 1.0, 1.0], 2), (1400, [1.0, -inf, 1.0], 2),
        (1500, [1.0, 1.0, 1.0], None), (1600, [], 1), (1601, [], 1), (1602, [], 2), (1700, [1.0, 1.0], 1), (1703, [1.0, 1.0], 1),
        (1702, [0.5, 0.5], 3), (1800, [0.0, 0.0, 0.0], 1), (-100, [1.0, 0.5, 0.25], 1), (200, [1.0, 0.5, 0.25], 9), (200, [1.0, 0.5, 1.0], 0),
        (1900, [-1.0] * 4, 1), (1901, [1.0] * 4, 1), (1902, [-0.5] * 4, 2),
    ]
    want = brute_force(rows)
    assert {r[0] for r in want} >= {1600, 1700, -100, 200} and found(spark, rows) == want


def test_large_components_are_exact(spark):
    rows = [(0, [3e8, 1.0], 1), (1, [2e8, 3.0], 1), (2, [9e7, 7.0], 2), (3, [9e7, 6.0], 2), (4, [1e7, 0.0], 3),
            (300, [1e30, 1.0], 1), (301, [1e30, 2.0], 1), (302, [1e3, 2.0], 2)]
    assert found(spark, rows) == brute_force(rows)


def test_empty_and_lonely(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_own_rule(spark):
    rows = random_rows(5, 300, 5, 0.7)
    rule = negatives.Rule(every=10, positives=2, negatives=3)
    assert found(spark, rows, rule=rule) == brute_force(rows, 10, 2, 3)
