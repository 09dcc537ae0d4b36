"""The hash-bootstrap forest against a scalar version, and fits for all regions at once against fits one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segrisk.operators import forest, regions
from segrisk.operators.features import expand_copies
from segrisk.operators.models import fit_cell_mean, fit_poisson

SCHEMA = "ogf_id long, district string, speed_limit double, number_of_lanes double, high_speed double, crash_count long, copies long"
NAMES = ["speed_limit", "number_of_lanes", "high_speed"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(300):
        speed, lanes = float(rng.choice([30, 50, 80])), float(rng.integers(1, 4))
        district = [None, "A", "B", "C", "small"][rng.integers(0, 5) if i < 290 else 1]
        district = "A" if district == "small" and i > 8 else district
        out.append((i - 20, district, speed, lanes, float(speed > 50), int(rng.poisson(2)), int(rng.choice([1, 1, 1, 2, 7]))))
    out.append((0, "C", 90.0, 9.0, 1.0, 40, 1))  # a combination of one row, which only some trees draw
    out.append((5, "B", 30.0, 7.0, 0.0, 3, 1))  # a combination that only one region has
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def draws(key, copy, tree, seed=42):
    h = (key % forest.PRIME * forest.MULTIPLIER + seed) % forest.PRIME
    for added in (copy, tree * forest.TREE_STEP, *forest.ADDED):
        h = (h * h + added) % forest.PRIME
    u, n, below = h / forest.PRIME, 0, math.exp(-1)
    while u >= below:
        n += 1
        below += math.exp(-1) / math.factorial(n)
    return n


def scalar_forest(rows, trees):
    """Predictions by looping over trees and rows."""
    units = {}
    for key, district, *features, y, copies in rows:
        units[key, tuple(features), y] = units.get((key, tuple(features), y), 0) + copies
    samples = [
        [(f, y, draws(k, c, t)) for (k, f, y), n in units.items() for c in range(1, n + 1)] for t in range(trees)
    ]

    def predict(features):
        means = []
        for sample in samples:
            for level in range(len(features), -1, -1):
                hit = [(y, w) for f, y, w in sample if w and f[:level] == features[:level]]
                if hit:
                    means.append(sum(y * w for y, w in hit) / sum(w for _, w in hit))
                    break
        return sum(means) / len(means) if means else None

    return predict


def predictions(df):
    return {(r.ogf_id, r.speed_limit, r.number_of_lanes): r.prediction for r in df.collect()}


def test_equals_the_scalar_version(table, rows):
    predict = scalar_forest(rows, 12)
    found = predictions(forest.fit_hash_forest(table, trees=12).transform(table))
    for key, _, *features, _, _ in rows:
        assert found[key, features[0], features[1]] == pytest.approx(predict(tuple(features)), rel=1e-12)


def test_unseen_combinations_back_off(spark, table, rows):
    asked = [(30.0, 99.0, 0.0), (1.0, 1.0, 0.0), (80.0, 2.0, 0.0)]
    df = spark.createDataFrame(asked, "speed_limit double, number_of_lanes double, high_speed double")
    predict = scalar_forest(rows, 9)
    found = forest.fit_hash_forest(table, trees=9).transform(df).collect()
    assert {tuple(r[:3]): pytest.approx(r.prediction) for r in found} == {a: predict(a) for a in asked}
    empty = forest.fit_hash_forest(table.where("false"), trees=9).transform(df)
    assert [r.prediction for r in empty.collect()] == [None] * 3


def test_layout_and_form_of_copies_do_not_matter(table):
    """Exactly the same numbers, from 1 or 13 partitions, and from copies or repeated rows."""
    fits = [table, table.repartition(13), table.coalesce(1), expand_copies(table)]
    found = [predictions(forest.fit_hash_forest(t, trees=20).transform(table)) for t in fits]
    assert all(f == found[0] for f in found)


def test_bootstrap_is_fair(spark):
    n, trees = 2000, 60
    rows = spark.range(n).selectExpr("id AS k", "1L AS c")
    drawn = forest.with_draws(rows, "k", "c", trees).collect()
    m = np.zeros((n, trees))
    m[[r.k for r in drawn], [r.tree for r in drawn]] = [r.draws for r in drawn]
    assert m.mean() == pytest.approx(1, abs=0.02) and m.var() == pytest.approx(1, abs=0.03)
    assert np.abs(np.corrcoef(m.T) - np.eye(trees)).max() < 5 / math.sqrt(n)
    between = np.corrcoef(m[:300])[np.triu_indices(300, 1)]
    assert abs(between.mean()) < 0.01 and between.std() == pytest.approx(1 / math.sqrt(trees), rel=0.1)


def test_text_keys_and_categories(spark, table):
    named = table.withColumn("ogf_id", F.concat(F.lit("s"), "ogf_id")).withColumn("kind", F.col("district"))
    model = forest.fit_hash_forest(named, features=["kind", "speed_limit"], trees=30)
    scored = model.transform(named).groupBy("kind").agg(F.count("prediction").alias("n"), F.count(F.lit(1)).alias("all"))
    assert all(r.n == r["all"] for r in scored.collect())  # NULL is a category as any other


def test_close_to_the_cell_mean(table):
    means = predictions(fit_cell_mean(table).transform(table))
    found = predictions(forest.fit_hash_forest(table, trees=200).transform(table))
    gaps = [abs(found[k] - means[k]) for k in means if k[2] < 5]
    assert max(gaps) < 0.35


def by_district(df):
    return {(r.ogf_id, r.district, r.speed_limit, r.number_of_lanes): r.prediction for r in df.collect()}


def test_forest_of_all_regions_at_once(table):
    at_once = by_district(forest.forest_without_region(table, trees=15))
    one_by_one = by_district(
        regions.leave_one_region_out(table, lambda t: forest.fit_hash_forest(t, trees=15))
    )
    assert at_once.keys() == one_by_one.keys() and {k[1] for k in at_once} == {"A", "B", "C"}
    assert all(at_once[k] == pytest.approx(v, rel=1e-12) for k, v in one_by_one.items())


@pytest.mark.parametrize("alpha, block", [(1.0, 512), (0.0, 2)])
def test_poisson_of_all_regions_at_once(table, monkeypatch, alpha, block):
    monkeypatch.setattr(regions, "REGION_BLOCK", block)
    at_once = by_district(regions.poisson_without_region(table, alpha=alpha))
    one_by_one = by_district(regions.leave_one_region_out(table, lambda t: fit_poisson(t, alpha=alpha)))
    assert at_once.keys() == one_by_one.keys()
    assert all(at_once[k] == pytest.approx(v, rel=1e-4) for k, v in one_by_one.items())


def test_poisson_of_regions_without_events_or_rows(table):
    only = table.withColumn("crash_count", F.when(F.col("district") == "A", F.col("crash_count")).otherwise(0))
    found = by_district(regions.poisson_without_region(only))
    assert {v for k, v in found.items() if k[1] == "A"} == {0.0} and all(v > 0 for k, v in found.items() if k[1] == "B")
    alone = regions.poisson_without_region(table.where("district = 'A'"))
    assert {math.isnan(r.prediction) for r in alone.collect()} == {True}
    assert regions.poisson_without_region(table.where("district IS NULL")).collect() == []
    assert forest.forest_without_region(table.where("district IS NULL"), trees=3).collect() == []
