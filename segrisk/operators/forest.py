"""A bagged forest whose bootstrap is a hash of the row, so that it is one aggregation and can be checked by SQL.

How often tree t draws a row is the Poisson(1) quantile of a hash of (key, copy, t): the limit of drawing n of n rows
with replacement, without any state of partitions or row order. A fully grown tree predicts the weighted mean label of
the rows in its sample that share the features. So the forest is the table of weighted sums per tree and feature
combination, made in one pass with partial aggregation, whatever the layout of the rows. Features of any type will do.

A tree that has not drawn a combination backs off along ``features``: it leaves out the last feature, then the one
before, until it has rows, at last to its overall mean. This is the path in a tree that splits on the features in
their order. The forest predicts the mean of its trees.

Equal rows of a key are drawn one by one, whether they are repeated or held as ``copies``. Rows of one key that differ
are drawn together, as the hold-out split keeps them together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from segrisk.operators.evaluate import metrics_by_region
from segrisk.operators.features import COPIES, expand_copies, require_columns, with_copies
from segrisk.operators.models import FEATURES, LABEL, PREDICTION
from segrisk.operators.regions import MIN_ROWS, region_eligible
from segrisk.session import materialise

TREES = 100
DEFAULT_SEED = 42

# A Mersenne prime, so that products stay below 2**63, and the constants of the rounds of the hash.
PRIME = 2_147_483_647
MULTIPLIER = 1_103_515_245
TREE_STEP = 362_436_069
ADDED = (521_288_629, 88_675_123)


def poisson_limits(modulus: int = PRIME) -> list[int]:
    """Where the quantile of Poisson(1) steps up: a value of ``modulus`` equally likely ones is drawn as often as it
    reaches limits."""
    limits, below = [], 0.0
    for k in range(100):
        below += math.exp(-1) / math.factorial(k)
        limit = math.ceil(below * modulus)
        if limit >= modulus or (limits and limit == limits[-1]):
            break
        limits.append(limit)
    return limits


def _key_hash(key: Column, copy: Column, seed: int) -> Column:
    start = F.pmod(F.pmod(key, F.lit(PRIME)) * MULTIPLIER + seed, F.lit(PRIME))
    return F.pmod(start * start + F.pmod(copy, F.lit(PRIME)), F.lit(PRIME))


def with_draws(rows: DataFrame, key: str, copy: str, trees: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``rows`` once for every tree, with ``tree`` and the number of its ``draws``, 0 too; a missing key is key 0.

    There is no filter on the draws: it would be pushed below the rounds and repeat them once per use.
    """
    value = F.col(key)
    if not isinstance(rows.schema[key].dataType, IntegralType):
        value = F.xxhash64(value)
    drawn = rows.withColumn("_h", _key_hash(F.coalesce(value, F.lit(0)).cast("long"), F.col(copy), seed))
    drawn = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    for added in (F.col("tree").cast("long") * TREE_STEP, *map(F.lit, ADDED)):
        drawn = drawn.withColumn("_h", F.pmod(F.col("_h") * F.col("_h") + F.pmod(added, F.lit(PRIME)), F.lit(PRIME)))
    steps = [F.when(F.col("_h") >= limit, 1).otherwise(0) for limit in poisson_limits()]
    return drawn.withColumn("draws", sum(steps[1:], steps[0]).cast("long")).drop("_h")


def bootstrap_sums(
    train: DataFrame,
    *,
    features: list[str] = FEATURES,
    label: str = LABEL,
    key: str = "ogf_id",
    trees: int = TREES,
    seed: int = DEFAULT_SEED,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``_weight`` and ``_sum`` of the labels that each tree draws, per feature combination (and column of ``by``).

    Whole-number labels are added as such, so the sums do not depend on the order of the rows.
    """
    require_columns(train, key, label, *features, *by)
    columns = [*dict.fromkeys([*by, *features, label, key])]
    kept = with_copies(train).groupBy(*columns).agg(F.sum(COPIES).alias(COPIES))  # equal rows get running numbers
    drawn = with_draws(expand_copies(kept, key, number="_copy"), key, "_copy", trees, seed)
    sums = drawn.groupBy(*by, "tree", *features).agg(
        F.sum(F.col(label) * F.col("draws")).alias("_sum"), F.sum("draws").alias("_weight")
    )
    return sums.where(F.col("_weight") > 0)


def _levels(sums: DataFrame, by: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """The sums for every number ``level`` of leading features, from all of them down to none."""
    rolled = sums.rollup(*by, "tree", *features).agg(
        F.grouping_id().alias("_gid"), F.sum("_sum").alias("_sum"), F.sum("_weight").alias("_weight")
    )
    # The id has one bit for every column left out, so it is 2 ** (features left out) - 1.
    left_out = F.bit_count("_gid").cast("int")
    return rolled.where(left_out <= len(features)).withColumn("level", len(features) - left_out).drop("_gid")


def _with_levels(cells: DataFrame, features: tuple[str, ...], trees: int) -> DataFrame:
    """Every cell for every tree and level; at a level the features beyond it are NULL in ``_at_<feature>``."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("level")
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("*", levels)
    return rows.withColumns({f"_at_{c}": F.when(F.col("level") > i, F.col(c)) for i, c in enumerate(features)})


def _matches(asked: DataFrame, sums: DataFrame, features: tuple[str, ...], by: tuple[str, ...]) -> Column:
    condition = (asked["tree"] == sums["tree"]) & (asked["level"] == sums["level"])
    for name in by:
        condition &= asked[name].eqNullSafe(sums[name])
    for name in features:
        condition &= asked[f"_at_{name}"].eqNullSafe(sums[name])
    return condition


def _forest_mean(found: DataFrame, keys: list[str], trees: int) -> DataFrame:
    """The mean over trees of the mean at the deepest level that a tree has, added up in the order of the trees."""
    deepest = found.groupBy(*keys, "tree").agg(F.max(F.struct("level", "mean"))["mean"].alias("mean"))
    means = deepest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tree", "mean"))).alias("means"))
    total = F.aggregate("means", F.lit(0.0), lambda a, x: a + x["mean"])
    return means.select(*keys, (total / F.size("means")).alias(PREDICTION))


def _joined(df: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    renamed = predictions.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= df[k].eqNullSafe(renamed[f"_key_{k}"])
    return df.join(renamed, condition, "left").select(*(df[c] for c in df.columns), renamed[PREDICTION])


@dataclass(frozen=True)
class HashForest:
    """Sums per tree and feature combination (a written table); the prediction is NULL if no tree drew any row."""

    sums: DataFrame
    features: tuple[str, ...]
    trees: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction. Each different feature combination is predicted once."""
        levels = _levels(self.sums, (), self.features)
        asked = _with_levels(df.select(*self.features).distinct(), self.features, self.trees)
        found = asked.join(levels, _matches(asked, levels, self.features, ())).select(
            *(asked[c] for c in self.features), asked["tree"], asked["level"],
            (levels["_sum"] / levels["_weight"]).alias("mean"),
        )
        return _joined(df, _forest_mean(found, list(self.features), self.trees), list(self.features))


def fit_hash_forest(
    train: DataFrame,
    *,
    features: list[str] = FEATURES,
    label: str = LABEL,
    key: str = "ogf_id",
    trees: int = TREES,
    seed: int = DEFAULT_SEED,
) -> HashForest:
    """One pass over ``train``; the forest is written to the shared folder."""
    sums = bootstrap_sums(train, features=features, label=label, key=key, trees=trees, seed=seed)
    return HashForest(materialise(sums, "forest"), tuple(features), trees)


def forest_without_region(
    table: DataFrame,
    *,
    region: str = "district",
    features: list[str] = FEATURES,
    label: str = LABEL,
    key: str = "ogf_id",
    trees: int = TREES,
    seed: int = DEFAULT_SEED,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The same as fitting the forest for every eligible region on all other rows, for all regions at once.

    The sums of a fold are those of all rows less those of the region, in every tree and at every level. The draws of
    a row do not depend on the other rows, so both are the same forest.
    """
    names, by = tuple(features), (region,)
    eligible = region_eligible(table, region, min_rows).select(region)
    sums = bootstrap_sums(table, features=features, label=label, key=key, trees=trees, seed=seed, by=by)
    sums = materialise(sums, "region_sums")
    every = sums.groupBy("tree", *names).agg(F.sum("_sum").alias("_sum"), F.sum("_weight").alias("_weight"))
    total, own = _levels(every, (), names), _levels(sums, by, names)
    cells = table.join(eligible, region).select(region, *names).distinct()
    asked = _with_levels(cells, names, trees)
    both = asked.join(total, _matches(asked, total, names, ())).select(
        *(asked[c] for c in asked.columns), total["_sum"].alias("_all"), total["_weight"].alias("_all_weight")
    )
    both = both.join(own, _matches(both, own, names, by), "left").select(
        *(both[c] for c in (region, *names, "tree", "level")),
        (both["_all"] - F.coalesce(own["_sum"], F.lit(0))).alias("_rest"),
        (both["_all_weight"] - F.coalesce(own["_weight"], F.lit(0))).alias("_rest_weight"),
    )
    found = both.where(F.col("_rest_weight") > 0).withColumn("mean", F.col("_rest") / F.col("_rest_weight"))
    predictions = _forest_mean(found, [region, *names], trees)
    return _joined(table.join(eligible, region, "left_semi"), predictions, [region, *names])


def loro_forest(table: DataFrame, *, region: str = "district", **options) -> DataFrame:
    """Pearson r, R² and RMSE per held-out region of the forest."""
    predictions = forest_without_region(table, region=region, **options)
    return metrics_by_region(expand_copies(with_copies(predictions), key=region), region)
