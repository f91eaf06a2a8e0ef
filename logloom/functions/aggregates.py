"""Aggregate expressions of the summary queries. All of them have a partial (map-side) form,
so a hot group collapses to one row per task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def distinct_count(column: str, alias: str, approximate: bool = False, rsd: float = 0.01) -> Column:
    """Exact distinct count, or a HyperLogLog++ estimate (fixed-size state, no distinct shuffle)."""
    if approximate:
        return F.approx_count_distinct(column, rsd).alias(alias)
    return F.count_distinct(F.col(column)).alias(alias)


def level_count(level: str, alias: str, column: str = "level") -> Column:
    """Rows of one level in the group (a NULL level counts for none)."""
    return F.count_if(F.col(column) == F.lit(level)).alias(alias)


def latest(column: str, alias: str) -> Column:
    return F.max(column).alias(alias)


def earliest(column: str, alias: str) -> Column:
    return F.min(column).alias(alias)


def mean(column: str, alias: str) -> Column:
    return F.avg(column).alias(alias)


def distinct_values(column: str, alias: str) -> Column:
    """Sorted distinct values of a column. ``collect_set`` de-duplicates map-side, so the
    shuffled state per group is bounded by the number of distinct values, not rows."""
    return F.sort_array(F.collect_set(column)).alias(alias)
