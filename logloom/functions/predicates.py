"""Row predicates of the summary queries. All are plain comparisons, so Parquet scans get them
as pushed filters, and those on the date partition column prune whole partitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.timeutil import day_literal

# ---------------------------------------------------------------------------------------------
# The level sets of the reference's summary queries.
ERROR_WARN = ("ERROR", "WARN")
ERROR_WARN_FATAL = ("ERROR", "WARN", "FATAL")
ERROR = "ERROR"
# ---------------------------------------------------------------------------------------------


def level_in(levels: Iterable[str], column: str = "level") -> Column:
    return F.col(column).isin(list(levels))


def level_is(level: str, column: str = "level") -> Column:
    return F.col(column) == F.lit(level)


def present(column: str) -> Column:
    return F.col(column).isNotNull()


def within_days(column: str, days: int = 7, as_of: dt.date | str | None = None) -> Column:
    """``column >= as_of - days`` (as_of defaults to today)."""
    return F.col(column) >= F.date_sub(day_literal(as_of), days)


def on_day(column: str, as_of: dt.date | str | None = None) -> Column:
    """``column = as_of`` (as_of defaults to today)."""
    return F.col(column) == day_literal(as_of)
