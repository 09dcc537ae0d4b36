"""Count models on segments. Solvers come from MLlib; fitted models add the column ``prediction``."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.functions.missing import zero_filled
from segrisk.operators.features import COPIES, HIGH_SPEED, expand_copies, require_columns, with_copies
from segrisk.schemas import NUMBER_OF_LANES, ROAD_CLASS, SPEED_LIMIT

FEATURES = [SPEED_LIMIT, NUMBER_OF_LANES, HIGH_SPEED]
LABEL = "crash_count"
PREDICTION = "prediction"

# MLlib accepts no deeper trees; the reference has no limit.
MAX_DEPTH = 30

# Partitions that a forest is fitted on. It is part of the model, like the seed.
FIT_PARTITIONS = 32


def feature_matrix(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """The feature columns as doubles with missing values set to 0; other columns stay."""
    require_columns(df, *features)
    return df.withColumns({c: zero_filled(c) for c in features})


class Model(Protocol):
    """What a fit returns."""

    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Forest:
    """A fitted MLlib pipeline without its helper columns in the output."""

    pipeline: PipelineModel
    helpers: tuple[str, ...] = ("_features",)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df).drop(*self.helpers)

    @property
    def trees(self) -> int:
        return self.pipeline.stages[-1].getNumTrees


def _forest(label: str, trees: int, max_bins: int, seed: int, bootstrap: bool = True) -> RandomForestRegressor:
    # All features and deep trees; the MLlib defaults (depth 5, a third of the features) fit another model.
    return RandomForestRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol=PREDICTION,
        numTrees=trees,
        featureSubsetStrategy="all",
        maxDepth=MAX_DEPTH,
        maxBins=max_bins,
        bootstrap=bootstrap,
        seed=seed,
        maxMemoryInMB=512,
    )


def _laid_out(train: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """The rows in a layout that depends on their content and ``partitions`` only.

    MLlib draws its bootstrap per partition and in row order, so this makes a fit reproducible whatever the number
    of cores, files or shuffle partitions. Rows held as ``copies`` are multiplied, for the bootstrap draws rows.
    """
    kept = train.select(*(c for c in dict.fromkeys([*columns, COPIES]) if c in train.columns))
    if COPIES in kept.columns:
        kept = expand_copies(kept, key=kept.columns[0])
    return kept.repartition(partitions, *kept.columns).sortWithinPartitions(*kept.columns)


def _distinct_values(train: DataFrame, features: list[str]) -> int:
    """The largest number of distinct values of a feature, at least the 2 bins that MLlib needs."""
    counts = [train.select(c).distinct().agg(F.count(F.lit(1)).alias("n")) for c in features]
    return max(2, *(int(r["n"]) for r in reduce(DataFrame.unionByName, counts).collect()))


def fit_random_forest(
    train: DataFrame,
    *,
    features: list[str] = FEATURES,
    label: str = LABEL,
    key: str = "ogf_id",
    trees: int = 100,
    max_bins: int | None = None,
    seed: int = 42,
    partitions: int = FIT_PARTITIONS,
) -> Forest:
    """Bagged regression trees over ``features``. ``train`` should be a written table: it is read repeatedly.

    A split may fall between any two values of a feature, unless ``max_bins`` sets a smaller number of value ranges.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    forest = _forest(label, trees, max_bins or _distinct_values(train, features), seed)
    rows = _laid_out(train, [key, *features, label], partitions)
    return Forest(Pipeline(stages=[assembler, forest]).fit(rows))


def fit_tree(
    train: DataFrame,
    *,
    features: list[str] = FEATURES,
    label: str = LABEL,
    key: str = "ogf_id",
    partitions: int = FIT_PARTITIONS,
) -> Forest:
    """One tree on all rows: predicts the mean label of each feature combination.

    MLlib limits the depth to ``MAX_DEPTH``, and above 10,000 rows or the square of the number of values it looks for
    splits in a sample, so that very rare values may share a prediction with their neighbours.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    tree = _forest(label, 1, _distinct_values(train, features), 42, bootstrap=False)
    rows = _laid_out(train, [key, *features, label], partitions)
    return Forest(Pipeline(stages=[assembler, tree]).fit(rows))


def fit_road_class_forest(
    train: DataFrame,
    *,
    label: str = LABEL,
    key: str = "ogf_id",
    trees: int = 100,
    max_bins: int | None = None,
    seed: int = 42,
    bootstrap: bool = True,
    partitions: int = FIT_PARTITIONS,
) -> Forest:
    """Forest over speed, lanes, road class and the high-speed flag; the class is indexed as a category.

    Unseen and missing classes share a category of their own. There are bins for every class.
    """
    numeric = [SPEED_LIMIT, NUMBER_OF_LANES, HIGH_SPEED]
    rows = _laid_out(train, [key, *numeric, ROAD_CLASS, label], partitions)
    indexer = StringIndexer(inputCol=ROAD_CLASS, outputCol="_class", handleInvalid="keep").fit(rows)
    categories = len(indexer.labels) + 1
    bins = max(categories, max_bins or _distinct_values(train, numeric))
    assembler = VectorAssembler(inputCols=[SPEED_LIMIT, NUMBER_OF_LANES, "_class", HIGH_SPEED], outputCol="_features")
    fitted = Pipeline(stages=[assembler, _forest(label, trees, bins, seed, bootstrap)]).fit(indexer.transform(rows))
    return Forest(PipelineModel([indexer, *fitted.stages]), helpers=("_class", "_features"))


@dataclass(frozen=True)
class PoissonModel:
    """log E[label] = intercept + sum(coefficient * feature), applied as a native column."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        linear = F.lit(self.intercept)
        for name, coefficient in zip(self.features, self.coefficients, strict=True):
            linear = linear + F.lit(coefficient) * F.col(name).cast("double")
        return df.withColumn(PREDICTION, F.exp(linear))


def fit_poisson(
    train: DataFrame,
    *,
    features: list[str] = FEATURES,
    label: str = LABEL,
    alpha: float = 1.0,
    max_iter: int = 300,
) -> PoissonModel:
    """Poisson regression with log link and penalty alpha / 2 * |w|^2 on the mean half deviance.

    Rows with equal features enter the likelihood only through their number and mean label, so the solver
    iterates over one weighted row per combination. MLlib divides the loss by the sum of working weights, which
    is the sum of labels at the optimum, hence the penalty is divided by the mean label.
    """
    cells = (
        with_copies(train)
        .groupBy(*features)
        .agg(F.sum(F.col(label) * F.col(COPIES)).cast("double").alias("_sum"), F.sum(COPIES).cast("double").alias("_weight"))
        .withColumn("_label", F.col("_sum") / F.col("_weight"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        mean = cells.agg(F.sum(F.col("_label") * F.col("_weight")) / F.sum("_weight")).first()[0]
        if mean is None:
            raise ValueError("no rows to fit on")
        if mean == 0:
            # Without any event the likelihood has no optimum; its limit predicts 0 everywhere.
            return PoissonModel(tuple(features), (0.0,) * len(features), -math.inf)
        assembler = VectorAssembler(inputCols=features, outputCol="_features")
        glm = GeneralizedLinearRegression(
            family="poisson",
            link="log",
            featuresCol="_features",
            labelCol="_label",
            weightCol="_weight",
            maxIter=max_iter,
            tol=1e-9,
            regParam=alpha / mean,
        )
        fitted = glm.fit(assembler.transform(cells))
        return PoissonModel(tuple(features), tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept))
    finally:
        cells.unpersist()


@dataclass(frozen=True)
class CellMeanModel:
    """Mean label per feature combination, the overall mean for unseen combinations: a forest's closed form."""

    means: DataFrame
    overall: DataFrame
    features: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.means, list(self.features), "left")
        filled = F.coalesce(F.col("_mean"), self.overall.scalar())
        return joined.withColumn(PREDICTION, filled).drop("_mean").select(*df.columns, PREDICTION)


def fit_cell_mean(train: DataFrame, *, features: list[str] = FEATURES, label: str = LABEL) -> CellMeanModel:
    """Lazy: nothing runs before the predictions are read."""
    sums = [F.sum(F.col(label) * F.col(COPIES)).alias("_sum"), F.sum(COPIES).alias("_rows")]
    cells = with_copies(train).groupBy(*features).agg(*sums)
    means = cells.select(*features, (F.col("_sum") / F.col("_rows")).alias("_mean"))
    overall = cells.agg((F.sum("_sum") / F.sum("_rows")).alias("_mean"))
    return CellMeanModel(means, overall, tuple(features))
