"""The standard compositions: segment table, model table, risk scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrisk.operators.features import COPIES, attributes_by_id, derive_features, expand_copies
from segrisk.operators.joins import join_by_id
from segrisk.operators.models import FEATURES, LABEL, PREDICTION, Model, feature_matrix
from segrisk.operators.spatial_join import crash_counts
from segrisk.operators.split import train_test
from segrisk.session import materialise
from segrisk.sources.bundle import Dataset


def segment_table(dataset: Dataset, *, mode: str = "rows", **options) -> DataFrame:
    """Segments with features and ``crash_count``; repeated rows are held as ``copies``.

    Attributes and counts are put together per id, in narrow rows, before the segments with their geometry are
    joined once. With ``mode="rows"`` a crash counts for every row that the attributes make of a segment.
    """
    ids = dataset.roads.select("ogf_id").distinct()
    features = derive_features(attributes_by_id(ids, dataset.speed, dataset.lanes, dataset.road_class))
    counts = crash_counts(dataset.roads, dataset.crashes, mode=mode, **options)
    by_id = features.join(counts, "ogf_id", "left").fillna(0, subset=[LABEL])
    if mode == "rows":
        # All rows that the attributes make of a segment: the copies of its combinations.
        rows = F.sum(COPIES).over(Window.partitionBy("ogf_id"))
        by_id = by_id.withColumn(LABEL, F.col(LABEL) * rows)
    return join_by_id(dataset.roads, by_id, "ogf_id")


def segment_rows(dataset: Dataset, *, mode: str = "rows", **options) -> DataFrame:
    """The segment table with every repeated row written out."""
    return expand_copies(segment_table(dataset, mode=mode, **options))


def model_table(
    dataset: Dataset, *, mode: str = "rows", keep: tuple[str, ...] = ("ogf_id", "district"), **options
) -> DataFrame:
    """Key, region, zero-filled features and label, written once so that fits and folds read a small table.

    Repeated rows are held as ``copies``, which weigh in every fit.
    """
    rows = feature_matrix(segment_table(dataset, mode=mode, **options))
    return materialise(rows.select(*keep, *FEATURES, LABEL, COPIES), "model_table")


def score_segments(model: Model, segments: DataFrame) -> DataFrame:
    """``predicted_risk`` for every segment; the feature columns keep their own values."""
    own = {c: f"_own_{c}" for c in FEATURES}
    kept = segments.withColumns({name: segments[c] for c, name in own.items()})
    scored = model.transform(feature_matrix(kept)).drop(*FEATURES)
    restored = scored.withColumnsRenamed({name: c for c, name in own.items()})
    return restored.withColumnRenamed(PREDICTION, "predicted_risk").select(*segments.columns, "predicted_risk")


def risk_table(dataset: Dataset, fit: Callable[[DataFrame], Model], *, mode: str = "rows", **options) -> DataFrame:
    """All segments with the risk predicted by a model fitted on the training part of the split.

    The segments are written once, because fitting and scoring both read them. Repeated rows are held as ``copies``
    up to the result: they weigh in the fit, and are scored once.
    """
    segments = materialise(segment_table(dataset, mode=mode, **options), "segments")
    train, _ = train_test(feature_matrix(segments).select("ogf_id", *FEATURES, LABEL, COPIES))
    return expand_copies(score_segments(fit(train), segments))
