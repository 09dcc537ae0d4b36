"""Hold-out split by segment, so that rows of one segment never fall on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# A prime modulus and a multiplicative-hash constant; products stay far below 2**63.
MODULUS = 1_000_003
MULTIPLIER = 2_654_435_761
DEFAULT_SEED = 42


def is_test(df: DataFrame, key: str = "ogf_id", fold_count: int = 5, seed: int = DEFAULT_SEED) -> Column:
    """True for about one in ``fold_count`` keys. Depends on the key alone, unlike a random split."""
    value = F.col(key)
    if not isinstance(df.schema[key].dataType, IntegralType):
        value = F.xxhash64(value)
    hashed = F.pmod(F.pmod(value, F.lit(MODULUS)) * MULTIPLIER + seed, F.lit(MODULUS))
    return F.coalesce(F.pmod(hashed, F.lit(fold_count)) == 0, F.lit(False))


def holdout_split(df: DataFrame, key: str = "ogf_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """``df`` with the boolean column ``is_test``; rows without a key stay in training."""
    return df.withColumn("is_test", is_test(df, key, seed=seed))


def train_test(df: DataFrame, key: str = "ogf_id", seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    test = is_test(df, key, seed=seed)
    return df.where(~test), df.where(test)
