"""The summary queries over the curated log tables.

Every query is a filter, one GROUP BY with partial (map-side) aggregation, and an ordering.
Top-N queries end in ``orderBy(...).limit(n)``, which Spark runs as a per-partition top-N plus
a final merge (``TakeOrderedAndProject``): no global sort of the groups. Each ordering ends
with the group keys, so the rows kept at a cut are the same on every run and engine.

``logs`` is a curated table: ``LOGS_APP`` (logger, partition_date, exception_*, http_*) for
the ``*_loggers`` / exception / HTTP queries, ``LOGS_SERVICE`` (source, user_id, session_id,
ip_address, date_partition) for the others. ``stamp`` adds the ``aggregation_timestamp``
column of a stored summary table (``"now"`` for the run time).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import aggregates as G
from logloom.functions import predicates as P
from logloom.functions.normalize import exception_label, hour_bucket, message_label
from logloom.functions.timeutil import ingest_time

Stamp = dt.datetime | str | None


def _desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def _asc(name: str) -> Column:
    return F.col(name).asc_nulls_first()


def _stamped(df: DataFrame, stamp: Stamp, name: str = "aggregation_timestamp") -> DataFrame:
    if stamp is None:
        return df
    value = ingest_time(None if stamp == "now" else stamp)
    return df.withColumn(name, value)


def _top_errors(logs, key: str, limit: int, levels: Sequence[str], stamp: Stamp) -> DataFrame:
    out = (
        logs.where(P.level_in(levels))
        .groupBy("level", key, "message")
        .agg(
            G.row_count("error_count"),
            G.latest("timestamp", "latest_occurrence"),
            G.earliest("timestamp", "first_occurrence"),
        )
        .orderBy(_desc("error_count"), _asc("level"), _asc(key), _asc("message"))
        .limit(limit)
    )
    return _stamped(out, stamp)


def top_errors_by_logger(logs: DataFrame, *, limit: int = 100, levels: Sequence[str] = P.ERROR_WARN, stamp: Stamp = None) -> DataFrame:
    """Q1: most frequent (level, logger, message) among error-ish rows, application logs."""
    return _top_errors(logs, "logger", limit, levels, stamp)


def top_errors_by_source(logs: DataFrame, *, limit: int = 100, levels: Sequence[str] = P.ERROR_WARN, stamp: Stamp = None) -> DataFrame:
    """Q2: most frequent (level, source, message) among error-ish rows, service logs."""
    return _top_errors(logs, "source", limit, levels, stamp)


def daily_summary_loggers(logs: DataFrame, *, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q3: rows and distinct loggers per (partition_date, level)."""
    out = (
        logs.groupBy("partition_date", "level")
        .agg(G.row_count("log_count"), G.distinct_count("logger", "unique_loggers", approximate))
        .orderBy(_desc("partition_date"), _asc("level"))
    )
    return _stamped(out, stamp)


def daily_summary_sources_users(logs: DataFrame, *, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q4: rows, distinct sources and distinct users per (date_partition, level)."""
    out = (
        logs.groupBy("date_partition", "level")
        .agg(
            G.row_count("log_count"),
            G.distinct_count("source", "unique_sources", approximate),
            G.distinct_count("user_id", "unique_users", approximate),
        )
        .orderBy(_desc("date_partition"), _asc("level"))
    )
    return _stamped(out, stamp)


def _hourly(logs, key: str, alias: str, levels, approximate, stamp) -> DataFrame:
    # Group on the truncated timestamp (8 bytes, no per-row string formatting) and format
    # only the aggregated rows; ordering by it equals ordering by the formatted text.
    out = (
        logs.where(P.level_in(levels))
        .groupBy(F.date_trunc("hour", F.col("timestamp")).alias("_hour"), "level")
        .agg(G.row_count("error_count"), G.distinct_count(key, alias, approximate))
        .orderBy(_desc("_hour"), _asc("level"))
        .select(hour_bucket(F.col("_hour")).alias("hour"), "level", "error_count", alias)
    )
    return _stamped(out, stamp)


def hourly_error_trends_loggers(logs: DataFrame, *, levels: Sequence[str] = P.ERROR_WARN_FATAL, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q5: error-ish rows and distinct loggers per hour and level."""
    return _hourly(logs, "logger", "unique_loggers", levels, approximate, stamp)


def hourly_error_trends_sources(logs: DataFrame, *, levels: Sequence[str] = P.ERROR_WARN_FATAL, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q6: error-ish rows and distinct sources per hour and level."""
    return _hourly(logs, "source", "unique_sources", levels, approximate, stamp)


def _activity(logs, key: str, levels: Sequence[str], stamp: Stamp) -> DataFrame:
    counts = [G.level_count(level, f"{level.lower()}_count") for level in levels]
    out = (
        logs.groupBy(key)
        .agg(
            G.row_count("total_logs"),
            *counts,
            G.latest("timestamp", "latest_log"),
            G.earliest("timestamp", "first_log"),
        )
        .orderBy(_desc("total_logs"), _asc(key))
    )
    return _stamped(out, stamp)


def logger_activity_summary(logs: DataFrame, *, levels: Sequence[str] = ("ERROR", "WARN", "INFO"), stamp: Stamp = None) -> DataFrame:
    """Q7: per logger, rows in total and per level (ERROR, WARN, INFO), latest and first."""
    return _activity(logs, "logger", levels, stamp)


def source_activity_summary(logs: DataFrame, *, levels: Sequence[str] = ("ERROR", "WARN", "INFO", "DEBUG"), stamp: Stamp = None) -> DataFrame:
    """Q8: per source, rows in total and per level (ERROR, WARN, INFO, DEBUG), latest and first."""
    return _activity(logs, "source", levels, stamp)


def exception_summary(logs: DataFrame, *, limit: int = 50, level: str = P.ERROR, stamp: Stamp = None) -> DataFrame:
    """Q9: ERROR rows per raw (exception_class, exception_message): count, latest, sorted
    distinct loggers. Grouping is on the raw columns; the NULL labels are applied after.

    The counts of all groups come first; loggers are gathered for the ``limit`` groups that are left only
    (their keys, at most ``limit`` rows, are broadcast), so no other group holds a set of loggers.
    """
    keys = ["exception_class", "exception_message"]
    errors = logs.where(P.level_is(level))
    top = (
        errors.groupBy(*keys)
        .agg(G.row_count("occurrence_count"), G.latest("timestamp", "latest_occurrence"))
        .orderBy(_desc("occurrence_count"), *map(_asc, keys))
        .limit(limit)
    )
    named = top.withColumn("_group", F.struct(*keys))
    loggers = errors.select(F.struct(*keys).alias("_of"), "logger").join(F.broadcast(named.select("_group")), F.expr("_of <=> _group"), "left_semi")
    loggers = loggers.groupBy("_of").agg(G.distinct_values("logger", "affected_loggers"))
    out = (
        named.join(loggers, F.expr("_group <=> _of"))
        .orderBy(_desc("occurrence_count"), *map(_asc, keys))
        .select(
            exception_label(F.col("exception_class")).alias("exception_class"),
            message_label(F.col("exception_message")).alias("exception_type"),
            "occurrence_count",
            "latest_occurrence",
            "affected_loggers",
        )
    )
    return _stamped(out, stamp)


def _top_with_distinct(logs: DataFrame, key: str, total: str, measures: Sequence[Column], distinct: dict[str, str], limit: int, approximate: bool) -> DataFrame:
    """The ``limit`` groups of most rows, with measures and distinct counts (alias -> column).

    Counting distinct values of two columns in one aggregation expands every row three-fold and ships all
    (group, value) pairs. Here the plain measures choose the groups first; only rows of these (their
    keys, at most ``limit`` rows, are broadcast) give (group, column, value) rows, which collapse to distinct ones
    inside tasks before they are shuffled by all three: a hot group is spread by its values. Approximate
    counts have a fixed state per group and go along with the measures.
    """
    known = logs.where(P.present(key))
    order = (_desc(total), _asc(key))
    if approximate:
        counts = [G.distinct_count(column, alias, True) for alias, column in distinct.items()]
        return known.groupBy(key).agg(G.row_count(total), *counts, *measures).orderBy(*order).limit(limit)
    top = known.groupBy(key).agg(G.row_count(total), *measures).orderBy(*order).limit(limit)
    rows = known.select(key, *distinct.values()).join(F.broadcast(top.select(key)), key, "left_semi")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("value")) for i, c in enumerate(distinct.values())])
    pairs = rows.select(key, F.inline(kinds)).where("value IS NOT NULL").groupBy(key, "kind", "value").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy(key).agg(*[F.count_if(F.col("kind") == i).alias(alias) for i, alias in enumerate(distinct)])
    zero = [F.coalesce(alias, F.lit(0)).alias(alias) for alias in distinct]
    columns = [c for c in top.columns if c not in (key, total)]
    return top.join(counts, key, "left").select(key, total, *zero, *columns).orderBy(*order)


def user_activity_summary(logs: DataFrame, *, limit: int = 1000, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q10: per known user: rows, distinct sessions and addresses, errors, latest, first."""
    measures = [G.level_count("ERROR", "error_count"), G.latest("timestamp", "latest_activity"), G.earliest("timestamp", "first_activity")]
    distinct = {"unique_sessions": "session_id", "unique_ip_addresses": "ip_address"}
    return _stamped(_top_with_distinct(logs, "user_id", "total_activity", measures, distinct, limit, approximate), stamp)


def ip_address_analysis(logs: DataFrame, *, limit: int = 500, approximate: bool = False, stamp: Stamp = None) -> DataFrame:
    """Q11: per known address: rows, distinct users and sessions, errors, latest, first."""
    measures = [G.level_count("ERROR", "error_count"), G.latest("timestamp", "latest_request"), G.earliest("timestamp", "first_request")]
    distinct = {"unique_users": "user_id", "unique_sessions": "session_id"}
    return _stamped(_top_with_distinct(logs, "ip_address", "total_requests", measures, distinct, limit, approximate), stamp)


def error_summary(logs: DataFrame, *, levels: Sequence[str] = P.ERROR_WARN, stamp: Stamp = None) -> DataFrame:
    """Q12: error-ish rows per (level, source): count and latest (stamp column ``created_at``)."""
    out = (
        logs.where(P.level_in(levels))
        .groupBy("level", "source")
        .agg(G.row_count("error_count"), G.latest("timestamp", "latest_occurrence"))
        .orderBy(_desc("error_count"), _asc("level"), _asc("source"))
    )
    return _stamped(out, stamp, "created_at")


def daily_level_counts(logs: DataFrame, *, date_column: str = "date_partition", stamp: Stamp = None) -> DataFrame:
    """Q13: rows per (day, level) (stamp column ``created_at``)."""
    out = (
        logs.groupBy(date_column, "level")
        .agg(G.row_count("log_count"))
        .orderBy(_desc(date_column), _asc("level"))
    )
    return _stamped(out, stamp, "created_at")


def level_distribution(logs: DataFrame) -> DataFrame:
    """Q14: rows per level, most frequent first."""
    return logs.groupBy("level").agg(G.row_count("count")).orderBy(_desc("count"), _asc("level"))


def total_count(logs: DataFrame) -> DataFrame:
    """Q15: number of rows, as a one-row frame."""
    return logs.agg(G.row_count("total_records"))


def latest_rows(logs: DataFrame, *, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """Q16: the n newest rows (ties broken by the remaining columns)."""
    cols = list(columns or logs.columns)
    rest = [c for c in cols if c != "timestamp"]
    return logs.select(*cols).orderBy(_desc("timestamp"), *[_asc(c) for c in rest]).limit(n)


def latest_rows_of_table(spark: SparkSession, table: str, *, date_column: str, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """Q16 on a table partitioned by the day of ``timestamp`` (rows without a time stand in the day of
    their ingestion): the same rows as ``latest_rows``, from the newest partitions only.

    The partitions are walked newest first by their names (catalog metadata, no data): a row of a later
    day is newer than any of an earlier one, so the walk stops when the days so far hold ``n`` rows with a
    time; each step looks at one column of one more day, and at ``n`` rows of it at most. Rows without a time come last:
    they matter, and all partitions are read, only where the whole table has fewer than ``n`` others.
    """
    logs = spark.table(table)
    names = spark.sql(f"SHOW PARTITIONS {table}").collect()
    prefix = date_column + "="
    days = sorted({part.removeprefix(prefix) for r in names for part in r["partition"].split("/") if part.startswith(prefix)}, reverse=True)
    found = 0
    for day in days:
        timed = logs.where((F.col(date_column) == F.lit(day).cast("date")) & F.col("timestamp").isNotNull())
        found += timed.select("timestamp").limit(n - found).count()
        if found >= n:
            return latest_rows(logs.where(F.col(date_column) >= F.lit(day).cast("date")), n=n, columns=columns)
    return latest_rows(logs, n=n, columns=columns)


def sample_rows(logs: DataFrame, *, n: int = 10, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Q17: n rows. Without ``order_by`` any n rows (cheapest: stops after the first tasks);
    with it, the first n in that order, which makes the sample repeatable."""
    out = logs.select(*(columns or logs.columns))
    if order_by:
        out = out.orderBy(*[_asc(c) for c in order_by])
    return out.limit(n)


def level_overview_recent(logs: DataFrame, *, days: int = 7, as_of: dt.date | str | None = None, approximate: bool = False) -> DataFrame:
    """Q18: rows and distinct loggers per level over the last ``days`` days (partition-pruned)."""
    return (
        logs.where(P.within_days("partition_date", days, as_of))
        .groupBy("level")
        .agg(G.row_count("log_count"), G.distinct_count("logger", "unique_loggers", approximate))
        .orderBy(_desc("log_count"), _asc("level"))
    )


def top_error_loggers_recent(logs: DataFrame, *, limit: int = 10, days: int = 7, as_of: dt.date | str | None = None, approximate: bool = False) -> DataFrame:
    """Q19: loggers with most ERROR rows over the last ``days`` days, with distinct exception classes."""
    return (
        logs.where(P.level_is(P.ERROR) & P.within_days("partition_date", days, as_of))
        .groupBy("logger")
        .agg(G.row_count("error_count"), G.distinct_count("exception_class", "unique_exceptions", approximate))
        .orderBy(_desc("error_count"), _asc("logger"))
        .limit(limit)
    )


def http_traffic(logs: DataFrame, *, as_of: dt.date | str | None = None) -> DataFrame:
    """Q20: HTTP rows of one day per (status, method): requests and mean response size."""
    return (
        logs.where(P.present("http_method") & P.on_day("partition_date", as_of))
        .groupBy("http_status", "http_method")
        .agg(G.row_count("request_count"), G.mean("response_size", "avg_response_size"))
        .orderBy(_desc("request_count"), _asc("http_status"), _asc("http_method"))
    )


def top_paths(logs: DataFrame, *, limit: int = 100) -> DataFrame:
    """Q22: most requested HTTP paths."""
    return (
        logs.where(P.present("http_method"))
        .groupBy("http_path")
        .agg(G.row_count("request_count"))
        .orderBy(_desc("request_count"), _asc("http_path"))
        .limit(limit)
    )


# --- Shared pre-aggregate for the application summaries ---------------------------------------
# Q3, Q5 and Q7 only need, per (day, hour, level, logger), the row count and the first and latest
# time. One scan of the log table builds that rollup (partial aggregation before its shuffle);
# its size is bounded by days x 24 x levels x loggers, not by the rows. The three summaries are
# then aggregates of the rollup, with results equal to the direct queries.

def _rows_sum(alias: str) -> Column:
    # A group of the rollup has at least one row, so the sum is never NULL; the coalesce gives
    # it the non-nullable type of the direct ``count``.
    return F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias(alias)


def hourly_rollup(logs: DataFrame, day: str, member: str) -> DataFrame:
    """Rows per (day, hour, level, member): ``rows``, ``first``, ``latest``. ``member`` is the logger or
    source column; rows without a time have a NULL hour in their day."""
    return logs.groupBy(day, F.date_trunc("hour", F.col("timestamp")).alias("hour_start"), "level", member).agg(
        G.row_count("rows"), G.earliest("timestamp", "first"), G.latest("timestamp", "latest")
    )


def hourly_logger_rollup(logs: DataFrame) -> DataFrame:
    """``hourly_rollup`` of ``LOGS_APP`` by logger."""
    return hourly_rollup(logs, "partition_date", "logger")


def daily_members_from_rollup(rollup: DataFrame, day: str, member: str, alias: str, *, stamp: Stamp = None) -> DataFrame:
    """Rows and distinct members per (day, level), as Q3 and Q4 have them."""
    out = (
        rollup.groupBy(day, "level")
        .agg(_rows_sum("log_count"), F.count_distinct(F.col(member)).alias(alias))
        .orderBy(_desc(day), _asc("level"))
    )
    return _stamped(out, stamp)


def hourly_members_from_rollup(rollup: DataFrame, member: str, alias: str, *, levels: Sequence[str] = P.ERROR_WARN_FATAL, stamp: Stamp = None) -> DataFrame:
    """Error-ish rows and distinct members per hour and level, as Q5 and Q6 have them."""
    out = (
        rollup.where(P.level_in(levels))
        .groupBy(F.col("hour_start").alias("_hour"), "level")
        .agg(_rows_sum("error_count"), F.count_distinct(F.col(member)).alias(alias))
        .orderBy(_desc("_hour"), _asc("level"))
        .select(hour_bucket(F.col("_hour")).alias("hour"), "level", "error_count", alias)
    )
    return _stamped(out, stamp)


def activity_from_rollup(rollup: DataFrame, member: str, levels: Sequence[str], *, stamp: Stamp = None) -> DataFrame:
    """Per member, rows in total and per level, latest and first, as Q7 and Q8 have them: a level's count is
    the sum of its rollup rows (0 when there are none, as ``count_if`` gives)."""
    counts = [
        F.coalesce(F.sum(F.when(F.col("level") == F.lit(level), F.col("rows"))), F.lit(0).cast("bigint")).alias(
            f"{level.lower()}_count"
        )
        for level in levels
    ]
    out = (
        rollup.groupBy(member)
        .agg(_rows_sum("total_logs"), *counts, F.max("latest").alias("latest_log"), F.min("first").alias("first_log"))
        .orderBy(_desc("total_logs"), _asc(member))
    )
    return _stamped(out, stamp)


def daily_summary_loggers_from_rollup(rollup: DataFrame, *, stamp: Stamp = None) -> DataFrame:
    """Q3 from ``hourly_logger_rollup``."""
    return daily_members_from_rollup(rollup, "partition_date", "logger", "unique_loggers", stamp=stamp)


def hourly_error_trends_loggers_from_rollup(rollup: DataFrame, *, levels: Sequence[str] = P.ERROR_WARN_FATAL, stamp: Stamp = None) -> DataFrame:
    """Q5 from ``hourly_logger_rollup``."""
    return hourly_members_from_rollup(rollup, "logger", "unique_loggers", levels=levels, stamp=stamp)


def logger_activity_summary_from_rollup(rollup: DataFrame, *, levels: Sequence[str] = ("ERROR", "WARN", "INFO"), stamp: Stamp = None) -> DataFrame:
    """Q7 from ``hourly_logger_rollup``."""
    return activity_from_rollup(rollup, "logger", levels, stamp=stamp)


# Application summaries built from the rollup (same table names as in APP_SUMMARIES).
APP_ROLLUP_SUMMARIES = {
    "daily_log_summary": daily_summary_loggers_from_rollup,
    "hourly_error_trends": hourly_error_trends_loggers_from_rollup,
    "logger_activity_summary": logger_activity_summary_from_rollup,
}


# Name -> function, for callers that pick summaries by name (e.g. a list of tables to build).
APP_SUMMARIES = {
    "top_errors_by_count": top_errors_by_logger,
    "daily_log_summary": daily_summary_loggers,
    "hourly_error_trends": hourly_error_trends_loggers,
    "logger_activity_summary": logger_activity_summary,
    "exception_summary": exception_summary,
}
SERVICE_SUMMARIES = {
    "top_errors_by_count": top_errors_by_source,
    "daily_log_summary": daily_summary_sources_users,
    "hourly_error_trends": hourly_error_trends_sources,
    "source_activity_summary": source_activity_summary,
    "user_activity_summary": user_activity_summary,
    "ip_address_analysis": ip_address_analysis,
}
