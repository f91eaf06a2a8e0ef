"""Exact distinct counts as mergeable states: bitmaps over dense ids.

A state is one row per (group, bucket) with a bitmap of 32,768 ids; states of one group and bucket merge by OR,
and a group's distinct count is the sum of its bitmaps' set bits. A state takes 4 KB for any number of rows, so
states pay where groups are few and share many values (days, hours, levels); where a group has a handful of
values (single users or addresses) the distinct pairs themselves are smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITMAP = "bucket", "bitmap"


def states(rows: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """(groups, bucket, bitmap) of the ids (from 1) in column ``number``; built inside tasks and merged
    after one shuffle of the states. Rows without an id count for nothing."""
    known = rows.where(F.col(number).isNotNull()).withColumn(BUCKET, F.bitmap_bucket_number(F.col(number)))
    return known.groupBy(*groups, BUCKET).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias(BITMAP))


def merged(found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """States of coarser ``groups``."""
    return found.groupBy(*groups, BUCKET).agg(F.bitmap_or_agg(F.col(BITMAP)).alias(BITMAP))


def counts(found: DataFrame, groups: Sequence[str], alias: str) -> DataFrame:
    """(groups, alias): distinct ids of each of the (coarser) groups."""
    total: Column = F.sum(F.bitmap_count(F.col(BITMAP))).alias(alias)
    return merged(found, groups).groupBy(*groups).agg(total)
