import numpy as np
import pytest
from pyspark.sql import functions as F

from segrisk.operators.models import (
    FEATURES,
    feature_matrix,
    fit_cell_mean,
    fit_poisson,
    fit_random_forest,
    fit_road_class_forest,
    fit_tree,
)
from segrisk.operators.split import holdout_split, train_test

SCHEMA = (
    "ogf_id long, speed_limit double, number_of_lanes double, high_speed double, road_class string, crash_count long"
)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 1500
    speed = rng.choice([30.0, 40, 50, 60, 80], n)
    lanes = rng.integers(1, 5, n).astype(float)
    high = (speed > 50).astype(float)
    y = rng.poisson(np.exp(-1 + 0.01 * speed + 0.1 * lanes))
    classes = rng.choice(["Local", "Ramp", "Freeway"], n)
    return [
        (i, float(speed[i]), float(lanes[i]), float(high[i]), str(classes[i]), int(y[i])) for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).cache()


def newton(x, y, alpha):
    """Minimises mean half deviance + alpha / 2 |w|^2 with a free intercept."""
    design = np.column_stack([np.ones(len(y)), x])
    penalty = alpha * np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(design.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(100):
        mu = np.exp(design @ beta)
        gradient = design.T @ (mu - y) / len(y) + penalty @ beta
        step = np.linalg.solve(design.T @ (design * mu[:, None]) / len(y) + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-13:
            break
    return beta


@pytest.mark.parametrize("alpha", [1.0, 0.1, 0.0])
def test_poisson_matches_newton(table, data, alpha):
    x, y = np.array([r[1:4] for r in data]), np.array([r[5] for r in data], float)
    beta = newton(x, y, alpha)
    model = fit_poisson(table, alpha=alpha)
    assert model.intercept == pytest.approx(beta[0], rel=1e-5, abs=1e-7)
    assert model.coefficients == pytest.approx(beta[1:], rel=1e-4, abs=1e-7)
    predicted = np.array([r.prediction for r in model.transform(table).orderBy("ogf_id").collect()])
    assert predicted == pytest.approx(np.exp(np.column_stack([np.ones(len(y)), x]) @ beta), rel=1e-5)


def test_poisson_without_events_or_rows(table):
    zero = table.withColumn("crash_count", F.lit(0).cast("bigint"))
    scored = fit_poisson(zero).transform(table)
    assert scored.agg(F.max("prediction")).first()[0] == 0.0
    with pytest.raises(ValueError, match="no rows"):
        fit_poisson(table.where("false"))


def test_tree_and_cell_mean_agree(table):
    tree = fit_tree(table).transform(table).select("ogf_id", F.col("prediction").alias("a"))
    cells = fit_cell_mean(table).transform(table).select("ogf_id", F.col("prediction").alias("b"))
    worst = tree.join(cells, "ogf_id").agg(F.max(F.abs(F.col("a") - F.col("b"))), F.count("a")).first()
    assert worst[0] < 1e-9 and worst[1] == 1500


def test_cell_mean_falls_back_to_the_overall_mean(spark, table):
    unseen = spark.createDataFrame([(9.0, 9.0, 0.0)], "speed_limit double, number_of_lanes double, high_speed double")
    overall = table.agg(F.avg("crash_count")).first()[0]
    assert fit_cell_mean(table).transform(unseen).first().prediction == pytest.approx(overall)


def test_forest_is_close_to_the_cell_means(table):
    forest = fit_random_forest(table)
    assert forest.trees == 100
    scored = forest.transform(table)
    assert scored.columns == [*table.columns, "prediction"]
    cells = fit_cell_mean(table).transform(table).select("ogf_id", F.col("prediction").alias("mean"))
    joined = scored.join(cells, "ogf_id")
    gap, spread = joined.agg(F.avg(F.abs(F.col("prediction") - F.col("mean"))), F.stddev("mean")).first()
    assert gap < 0.1 * spread
    again = fit_random_forest(table).transform(table).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(scored.agg(F.sum("prediction")).first()[0], rel=1e-12)


def test_forest_with_road_class(spark, table):
    model = fit_road_class_forest(table, trees=10)
    odd = table.limit(3).withColumn("road_class", F.lit("Never seen")).unionByName(
        table.limit(3).withColumn("road_class", F.lit(None).cast("string"))
    )
    scored = model.transform(odd)
    assert scored.columns == [*table.columns, "prediction"]
    assert scored.where(F.col("prediction").isNotNull()).count() == 6


def test_feature_matrix(spark):
    df = spark.createDataFrame(
        [(1, None, 2, True), (2, float("nan"), None, None)],
        "ogf_id long, speed_limit double, number_of_lanes int, high_speed boolean",
    )
    assert [tuple(r) for r in feature_matrix(df).collect()] == [(1, 0.0, 2.0, 1.0), (2, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="high_speed"):
        feature_matrix(df.drop("high_speed"), FEATURES)


def test_split_is_by_key(spark):
    ids = [*range(-500, 2000), None]
    df = spark.createDataFrame([(i,) for i in ids], "ogf_id long")
    once = {r.ogf_id: r.is_test for r in holdout_split(df).collect()}
    expected = {i: ((i % 1000003) * 2654435761 + 42) % 1000003 % 5 == 0 for i in ids if i is not None}
    assert once == {**expected, None: False}
    assert 0.17 < sum(once.values()) / len(once) < 0.23
    doubled = df.union(df).repartition(7)
    train, test = train_test(doubled)
    assert train.count() + test.count() == 2 * len(ids)
    assert train.join(test, "ogf_id").count() == 0
    named = df.select(F.concat(F.lit("seg-"), "ogf_id").alias("ogf_id"))
    assert 0.15 < holdout_split(named).where("is_test").count() / len(ids) < 0.25
    other = {r.ogf_id for r in holdout_split(df, seed=43).where("is_test").collect()}
    assert other != {i for i, t in once.items() if t}


def test_forest_does_not_depend_on_the_layout_of_its_input(spark, table):
    found = []
    for n, shuffles in ((1, "3"), (7, "11")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        forest = fit_random_forest(table.repartition(n), trees=5)
        found.append(sorted((r.ogf_id, r.prediction) for r in forest.transform(table).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_many_classes_and_many_values(spark):
    classes = spark.range(400).selectExpr(
        "id AS ogf_id", "double(50) AS speed_limit", "double(1) AS number_of_lanes", "double(0) AS high_speed",
        "concat('class ', id % 200) AS road_class", "id % 200 AS crash_count",
    )
    tree = fit_road_class_forest(classes, trees=1, bootstrap=False)
    assert tree.transform(classes).where("abs(prediction - crash_count) > 1e-9").count() == 0
    speeds = classes.selectExpr("ogf_id", "double(ogf_id % 300) AS speed_limit", "number_of_lanes", "high_speed", "ogf_id % 300 AS crash_count")
    assert fit_tree(speeds).transform(speeds).where("abs(prediction - crash_count) > 1e-9").count() == 0
