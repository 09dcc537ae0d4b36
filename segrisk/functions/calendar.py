"""Calendar columns of a crash date."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single letters accept padded and unpadded fields alike, four of "y" reject two-digit years.
DATE_PATTERN = "M/d/yyyy h:mm:ss a"

# Labels by weekday number, Monday = 0.
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def parse_date(column: str) -> Column:
    """Wall-clock time of a 12-hour date string; NULL where it does not parse. Needs a UTC session zone."""
    return F.try_to_timestamp(F.col(column), F.lit(DATE_PATTERN)).cast("timestamp_ntz")


def weekday_name(weekday: str) -> Column:
    """Label of a weekday number, NULL outside 0..6 (locale-free, unlike a date format)."""
    pairs = chain.from_iterable((F.lit(i), F.lit(name)) for i, name in enumerate(WEEKDAY_NAMES))
    return F.try_element_at(F.create_map(*pairs), F.col(weekday))


def calendar_columns(timestamp: str) -> dict[str, Column]:
    """hour 0-23, weekday Monday=0, month and year of ``timestamp``."""
    value = F.col(timestamp)
    return {
        "hour": F.hour(value),
        "weekday": F.weekday(value),
        "month": F.month(value),
        "year": F.year(value),
    }
