import numpy as np
import pytest
from pyspark.sql import functions as F

from segrisk.operators.evaluate import (
    metrics_by_region,
    pred_vs_actual_summary,
    regression_metrics,
    residual_histogram,
    with_residual,
)
from segrisk.operators.models import fit_cell_mean, fit_tree
from segrisk.operators.regions import cell_mean_without_region, leave_one_region_out, loro_metrics, loro_train_sizes, region_eligible


def frame(spark, rows):
    return spark.createDataFrame(rows, "district string, crash_count long, prediction double")


def test_scores(spark):
    rng = np.random.default_rng(5)
    y, p = rng.poisson(2, 300), rng.normal(2, 1, 300)
    df = frame(spark, [("A" if i % 3 else "B", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))])
    all_rows = regression_metrics(df).first()
    sse = ((y - p) ** 2).sum()
    assert all_rows.n_rows == 300
    assert all_rows.r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())
    assert all_rows.rmse == pytest.approx(np.sqrt(sse / 300))
    for row in metrics_by_region(df).collect():
        chosen = np.arange(300) % 3 != 0 if row.district == "A" else np.arange(300) % 3 == 0
        assert row.pearson_r == pytest.approx(np.corrcoef(y[chosen], p[chosen])[0, 1])
        assert row.rmse == pytest.approx(np.sqrt(np.mean((y[chosen] - p[chosen]) ** 2)))


def test_undefined_scores_are_null(spark):
    df = frame(spark, [("A", 1, 2.0), ("A", 3, 2.0), ("B", 2, 1.0), ("B", 2, 3.0), ("C", 5, 4.0)])
    rows = {r.district: r for r in metrics_by_region(df).collect()}
    assert [rows[d].pearson_r for d in "ABC"] == [None, None, None]
    assert [rows[d].rmse for d in "ABC"] == [1.0, 1.0, 1.0]
    assert rows["A"].r2 == 0.0 and rows["B"].r2 is None and rows["C"].r2 is None
    empty = regression_metrics(df.where("false")).first()
    assert (empty.n_rows, empty.r2, empty.rmse) == (0, None, None)


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(1).normal(0, 1, 2000),
        np.repeat(np.linspace(-1.1, 2.3, 31), 3),
        np.round(np.random.default_rng(2).normal(0, 3, 3000), 1),
        np.full(7, 4.2),
        np.array([1.0, 1.0 + 1e-12]),
    ],
)
def test_histogram_is_numpys(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "residual double")
    rows = residual_histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=30)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.lower for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1].upper == edges[-1]


def test_residual_and_summary(spark):
    df = frame(spark, [("A", 1, 0.5), ("A", 1, 0.501), ("A", 4, 2.0)])
    assert [r.residual for r in with_residual(df).collect()] == pytest.approx([0.5, 0.499, 2.0])
    rows = {(r.crash_count, r.predicted): (r.n, r.label_min, r.label_max) for r in pred_vs_actual_summary(df).collect()}
    assert rows == {(1, 0.5): (2, 1, 4), (4, 2.0): (1, 1, 4)}


def regions_table(spark):
    rows = [(d, 1.0, 1.0, 0.0, c) for d, c, k in (("A", 1, 12), ("B", 3, 10), ("TINY", 50, 9)) for _ in range(k)]
    rows += [(None, 1.0, 1.0, 0.0, 100)] * 5
    return spark.createDataFrame(
        rows, "district string, speed_limit double, number_of_lanes double, high_speed double, crash_count long"
    )


def test_region_folds(spark):
    table = regions_table(spark)
    assert {(r.district, r.n_rows) for r in region_eligible(table).collect()} == {("A", 12), ("B", 10)}
    sizes = {(r.district, r.n_test, r.n_train) for r in loro_train_sizes(table).collect()}
    assert sizes == {("A", 12, 24), ("B", 10, 26)}
    # Small and unnamed regions train every fold and are never predicted.
    expected = {"A": (10 * 3 + 9 * 50 + 500) / 24, "B": (12 * 1 + 9 * 50 + 500) / 26}
    for fit in (fit_cell_mean, fit_tree):
        for parallelism in (1, 4):
            predictions = leave_one_region_out(table, fit, parallelism=parallelism)
            got = {(r.district, round(r.prediction, 9)) for r in predictions.collect()}
            assert got == {(d, round(v, 9)) for d, v in expected.items()}
    scores = {r.district: r for r in loro_metrics(table, fit_cell_mean).collect()}
    assert scores["A"].n_rows == 12 and scores["A"].pearson_r is None
    assert scores["A"].rmse == pytest.approx(expected["A"] - 1)


def test_region_edge_cases(spark):
    table = regions_table(spark)
    with pytest.raises(ValueError, match="NEIGHBOURHOOD"):
        loro_metrics(table, fit_cell_mean, region="NEIGHBOURHOOD")
    none = leave_one_region_out(table.where(F.col("district") == "TINY"), fit_cell_mean)
    assert none.count() == 0 and none.columns[-1] == "prediction"


def test_cell_mean_of_any_number_of_regions(spark):
    rows = spark.range(3003).selectExpr(
        "id AS ogf_id", "IF(id % 97 = 0, NULL, concat('R', id % 1001)) AS district", "double(id % 4) AS speed_limit",
        "double(id % 3) AS number_of_lanes", "double(0) AS high_speed", "id % 5 AS crash_count",
    )
    data = [(r.ogf_id, r.district, (r.speed_limit, r.number_of_lanes), r.crash_count) for r in rows.collect()]
    got = {r.ogf_id: r.prediction for r in cell_mean_without_region(rows, min_rows=2).collect()}
    assert len({d for i, d, _, _ in data if i in got}) > 900
    for i, district, cell, _ in data[:60]:
        if i in got:
            same = [y for _, d, c, y in data if d != district and c == cell]
            assert got[i] == pytest.approx(sum(same) / len(same))


def test_one_pass_equals_the_folds(spark):
    rows = spark.range(200).selectExpr(
        "id AS ogf_id", "IF(id % 9 = 0, NULL, concat('R', id % 4)) AS district", "double(id % 7) AS speed_limit",
        "double(id % 3) AS number_of_lanes", "double(id % 2) AS high_speed", "(id * id) % 5 AS crash_count",
    )
    one = {r.ogf_id: r.prediction for r in cell_mean_without_region(rows).collect()}
    folds = {r.ogf_id: r.prediction for r in leave_one_region_out(rows, fit_cell_mean).collect()}
    assert one.keys() == folds.keys() and all(one[k] == pytest.approx(folds[k]) for k in one)
