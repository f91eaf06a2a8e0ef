"""Stored rollups of mergeable partial states, refreshed day by day.

From a log table partitioned by day, ``refresh_rollup`` keeps, in tables partitioned by the same day:

* ``rollup_cells``: per (day, hour, level, logger or source) the rows and the first and latest time. Rows without
  a time have a NULL hour in the day of their ingestion, so they come and go with that day.
* ``rollup_users`` (service logs): per (day, level) the bitmaps of the users seen, over the dense ids of
  ``rollup_user_ids`` (``functions.bitmaps``); they merge exactly over any days.

A refresh reads only its days' logs and replaces only their partitions. Every daily, hourly and per-logger or
per-source summary of any window is then an aggregate of the rollup, whose size is bounded by days x 24 x levels x
loggers (and 4 KB per day, level and 32,768 users): history is never read again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import bitmaps
from logloom.functions.predicates import within_days
from logloom.operators import summaries as Q
from logloom.plans import tables as T
from logloom.session import shared_dir

CELLS, USERS, USER_IDS = "rollup_cells", "rollup_users", "rollup_user_ids"
WORKING_TABLES = (CELLS, USERS, USER_IDS)


@dataclass(frozen=True)
class Kind:
    """What a log table's rollup is made of."""

    day: str
    member: str
    user: str | None


KINDS = {
    "app": Kind(schemas.LOGS_APP_PARTITION, "logger", None),
    "service": Kind(schemas.LOGS_SERVICE_PARTITION, "source", "user_id"),
}


def extend_dictionary(spark: SparkSession, table: str, values: DataFrame) -> DataFrame:
    """Give every new value of the one column of ``values`` the next dense id (from 1) in ``table`` (``value``,
    ``id``); the table. Values are numbered inside ranges, and only the ranges' sizes meet in one window.
    One writer at a time."""
    T.create_table(spark, table, spark.createDataFrame([], "value string, id long").schema)
    known = spark.table(table)
    new = values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct().join(known, "value", "left_anti")
    folder = shared_dir(spark, "dictionary")
    new.repartitionByRange("value").withColumn("part", F.spark_partition_id()).write.parquet(folder)  # ranges are drawn once
    ranged = spark.read.schema("value string, part int").parquet(folder)
    start = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("part").agg(F.count("value").alias("n")).select("part", (before + start).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    numbered = ranged.withColumn("place", place).join(offsets, "part").select("value", (F.col("offset") + F.col("place")).alias("id"))
    T.append(numbered, table)
    T._delete(spark, folder)
    return spark.table(table)


def _replace_days(rows: DataFrame, table: str, day: str, inside: Column | None) -> None:
    """Replace the partitions of the refreshed days; days of the window that have no rows any more go."""
    spark = rows.sparkSession
    T.overwrite_partitions(rows, table, partition_by=[day])
    stored = spark.table(table).select(day).distinct()
    stored = stored if inside is None else stored.where(inside)
    for gone in stored.join(rows.select(day).distinct(), day, "left_anti").collect():  # days
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({day} = '{gone[0]}')")


def refresh_rollup(spark: SparkSession, source: str, database: str, *, kind: str = "service", days: int | None = None, as_of: dt.date | str | None = None) -> None:
    """Bring the rollup tables in ``database`` up to date for the last ``days`` days of ``source`` (all days:
    None)."""
    T.create_database(spark, database)
    k = KINDS[kind]
    inside = None if days is None else within_days(k.day, days, as_of)
    logs = spark.table(source) if inside is None else spark.table(source).where(inside)
    folder = shared_dir(spark, "rollup")
    cells = Q.hourly_rollup(logs, k.day, k.member)
    cells.write.parquet(folder)
    _replace_days(spark.read.schema(cells.schema).parquet(folder), f"{database}.{CELLS}", k.day, inside)
    T._delete(spark, folder)
    if k.user:
        pairs = logs.where(F.col(k.user).isNotNull()).select(k.day, "level", k.user).distinct()
        folder = shared_dir(spark, "rollup")
        pairs.write.parquet(folder)  # read for the new ids and for the bitmaps
        pairs = spark.read.schema(pairs.schema).parquet(folder)
        ids = extend_dictionary(spark, f"{database}.{USER_IDS}", pairs.select(k.user))
        numbered = pairs.join(ids, pairs[k.user] == ids["value"])
        _replace_days(bitmaps.states(numbered, [k.day, "level"], "id"), f"{database}.{USERS}", k.day, inside)
        T._delete(spark, folder)


def daily_sources_users(cells: DataFrame, users: DataFrame, *, stamp: Q.Stamp = None) -> DataFrame:
    """Q4 from the rollup: rows and distinct sources of the cells, distinct users of the bitmaps."""
    day = schemas.LOGS_SERVICE_PARTITION
    rows = Q.daily_members_from_rollup(cells, day, "source", "unique_sources").withColumnRenamed("level", "_level").withColumnRenamed(day, "_day")
    seen = bitmaps.counts(users, [day, "level"], "unique_users")
    both = rows.join(seen, F.col("_day").eqNullSafe(F.col(day)) & F.col("_level").eqNullSafe(F.col("level")), "left")
    both = both.select(F.col("_day").alias(day), F.col("_level").alias("level"), "log_count", "unique_sources", F.coalesce("unique_users", F.lit(0)).alias("unique_users"))
    return Q._stamped(both.orderBy(Q._desc(day), Q._asc("level")), stamp)


def window_users(spark: SparkSession, database: str, *, days: int = 7, as_of: dt.date | str | None = None) -> DataFrame:
    """Exact distinct users per level over the last ``days`` days, from the days' bitmaps alone."""
    users = spark.table(f"{database}.{USERS}").where(within_days(schemas.LOGS_SERVICE_PARTITION, days, as_of))
    return bitmaps.counts(users, ["level"], "unique_users").orderBy(Q._asc("level"))


def rollup_summaries(spark: SparkSession, database: str, kind: str) -> dict[str, Callable[..., DataFrame]]:
    """Summary tables that the rollup gives: name -> function of ``stamp`` (its other argument is not used)."""
    cells = spark.table(f"{database}.{CELLS}")
    if kind == "app":
        return {name: lambda _, stamp=None, f=f: f(cells, stamp=stamp) for name, f in Q.APP_ROLLUP_SUMMARIES.items()}
    users = spark.table(f"{database}.{USERS}")
    return {
        "daily_log_summary": lambda _, stamp=None: daily_sources_users(cells, users, stamp=stamp),
        "hourly_error_trends": lambda _, stamp=None: Q.hourly_members_from_rollup(cells, "source", "unique_sources", stamp=stamp),
        "source_activity_summary": lambda _, stamp=None: Q.activity_from_rollup(cells, "source", ("ERROR", "WARN", "INFO", "DEBUG"), stamp=stamp),
    }


def refresh_summaries(spark: SparkSession, source: str, database: str, *, kind: str = "service", days: int | None = 1, as_of: dt.date | str | None = None, stamp: str | None = "now") -> list[str]:
    """Refresh the rollup for the last ``days`` days and rewrite the daily, hourly and per-member summary tables
    from it (small tables, replaced by one pointer change each). The result equals a full rebuild."""
    refresh_rollup(spark, source, database, kind=kind, days=days, as_of=as_of)
    return T.build_tables(spark, spark.table(source), database, rollup_summaries(spark, database, kind), stamp=stamp)
