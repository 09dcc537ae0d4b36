"""Missing-value rules shared by the operators: NaN and NULL both mean "missing"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(column: str | Column) -> Column:
    """``column`` as a double with NaN turned into NULL; text that is not a number raises (ANSI cast)."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def zero_filled(column: str | Column) -> Column:
    """Numeric or boolean ``column`` as a double, missing values become 0."""
    return F.coalesce(as_double(column), F.lit(0.0))


def exceeds(column: str | Column, limit: float) -> Column:
    """Strict comparison that is False, not NULL, for missing values (a bare NaN would compare as greater)."""
    return F.coalesce(as_double(column) > F.lit(float(limit)), F.lit(False))
