"""End-to-end jobs: batch ingest, service-log ingest, source check, summary build, report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import parse as parse_ops
from logloom.operators import summaries as Q
from logloom.plans import rollups
from logloom.plans import script as S
from logloom.plans import tables as T
from logloom.sources.files import ACCESS_GLOB, JSON_GLOB, read_logs, read_records
from logloom.sources.generate import generate_service_logs


# Within each date partition, rows are stored sorted by level, so the level filters of the
# summary queries skip row groups.
LAYOUT_SORT = ("level",)
REJECTS_SUFFIX = "_rejects"


@dataclass
class IngestResult:
    rows_written: int
    rows_quarantined: int | None = None


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def ingest_logs(
    spark: SparkSession,
    raw_prefix: str,
    table: str,
    *,
    prefer: str = "both",
    allow_dash_size: bool = False,
    ingest_ts: dt.datetime | str | None = None,
    fmt: str = "parquet",
    quarantine_table: str | None = None,
    keep_rejects: bool = True,
    rebalance: bool = False,
    batch_id: str | None = None,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
) -> IngestResult:
    """Parse the access and JSON logs under ``raw_prefix`` and append them to ``table``
    (``LOGS_APP``, partitioned by ``partition_date``), creating database and table if needed.

    With ``batch_id`` the run can be repeated: both tables are also partitioned by ``ingest_batch``, and rows
    and rejects of an earlier, whole or half-finished run of the same batch are replaced
    (``tables.append_batch``). Without it every run appends.

    One job reads, parses and writes the good rows, and counts all lines and the quarantined
    ones on the way (``observe``: no extra count pass). The set-aside lines are
    appended to ``quarantine_table`` (default: ``<table>_rejects``; ``keep_rejects=False`` only counts
    them) by a second pass over the input, which runs only when the first job found any (``ingest_logs_single_pass`` stores both from one pass, with the
    two tables side by side under one folder). ``rebalance`` regroups rows by date before writing (one
    shuffle, fewer and fuller files; see ``tables.append``). Missing input raises; nothing is
    invented.
    """
    if "." in table:
        T.create_database(spark, table.rsplit(".", 1)[0])
    if batch_id is None:
        T.create_table(spark, table, schemas.LOGS_APP, partition_by=[schemas.LOGS_APP_PARTITION], fmt=fmt)
    seen = Observation("ingest")
    good, bad = read_logs(
        spark, raw_prefix, prefer=prefer, allow_dash_size=allow_dash_size, ingest_ts=ingest_ts, observation=seen,
        access_glob=access_glob, json_glob=json_glob,
    )
    rejects = quarantine_table or table + REJECTS_SUFFIX
    if batch_id is not None:
        T.append_batch(good, table, batch_id, partition_by=[schemas.LOGS_APP_PARTITION], fmt=fmt, sort_within=LAYOUT_SORT)
    else:
        T.append(good, table, partition_by=[schemas.LOGS_APP_PARTITION], fmt=fmt, sort_within=LAYOUT_SORT, rebalance=rebalance)
    counts = seen.get
    quarantined = int(counts["quarantined"])
    result = IngestResult(int(counts["lines"]) - quarantined, quarantined)
    if keep_rejects and batch_id is not None:
        # Also without rejects: those of an earlier attempt go.
        T.append_batch(bad, rejects, batch_id, fmt=fmt)
    elif keep_rejects and quarantined:
        T.append(bad, rejects, fmt=fmt)
    return result


# Single-pass ingest layout: one folder holds the log table and the quarantine table, as
# the two values of a leading ``outcome`` partition column.
OUTCOME, OUTCOME_LOGS, OUTCOME_REJECTS = parse_ops.OUTCOME, parse_ops.OUTCOME_LOGS, parse_ops.OUTCOME_REJECTS


def _path(location: str) -> str:
    """A folder name without a ``file:`` scheme and trailing slash, for comparisons."""
    if location.startswith("file:"):
        location = "/" + location[len("file:"):].lstrip("/")
    return location.rstrip("/")


def ingest_logs_single_pass(
    spark: SparkSession,
    raw_prefix: str,
    table: str,
    quarantine_table: str,
    root: str,
    *,
    prefer: str = "both",
    allow_dash_size: bool = False,
    ingest_ts: dt.datetime | str | None = None,
    rebalance: bool = False,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
) -> IngestResult:
    """Batch ingest that stores the good rows and the quarantined lines in one pass over the
    input: one job reads, parses and writes both.

    Both tables live under ``root``: ``table`` (``LOGS_APP``) at ``root/outcome=logs`` and
    ``quarantine_table`` (``QUARANTINE_BY_DATE``: format, value, reason and the ingestion day
    as ``partition_date``) at ``root/outcome=rejects``; they are created there if absent and
    must be there if present. Every parsed line becomes one row of a single DataFrame carrying
    the columns of both shapes and an ``outcome`` column, written to ``root`` partitioned by
    ``outcome`` and ``partition_date``. Each table reads only its own columns from its files.
    The one job commits both outputs together (a failed job commits neither, so no input is
    read twice and nothing is half-written); the date folders it wrote, gathered on the way, are then
    registered in both tables without listing them. A mark file stands under ``root`` meanwhile: a run that
    finds the mark of another, stopped before it could register, lists all folders once. Parquet only.
    """
    for name, schema, folder in (
        (table, schemas.LOGS_APP, OUTCOME_LOGS),
        (quarantine_table, schemas.QUARANTINE_BY_DATE, OUTCOME_REJECTS),
    ):
        location = f"{root.rstrip('/')}/{OUTCOME}={folder}"
        if "." in name:
            T.create_database(spark, name.rsplit(".", 1)[0])
        if T.table_exists(spark, name):
            if _path(T.table_location(spark, name)) != _path(location):
                raise ValueError(f"{name} is not stored at {location}")
        else:
            T.create_table(spark, name, schema, partition_by=[schemas.LOGS_APP_PARTITION], location=location)
    stopped = T.pending_marks(spark, root)
    mark = T.mark_pending(spark, root)
    seen = Observation("ingest")
    records, ingest = read_records(
        spark, raw_prefix, prefer=prefer, allow_dash_size=allow_dash_size, ingest_ts=ingest_ts,
        access_glob=access_glob, json_glob=json_glob, observation=seen,
    )
    rows = parse_ops.outcome_rows(records, ingest)
    parts = (OUTCOME, schemas.LOGS_APP_PARTITION)
    if rebalance:
        rows = rows.hint("rebalance", *parts)
    # The days of both sides, gathered while they are written: only these are registered.
    written = Observation("days")
    day = F.col(schemas.LOGS_APP_PARTITION).cast("string")
    rows = rows.observe(written, *[F.collect_set(F.when(F.col(OUTCOME) == side, day)).alias(side) for side in (OUTCOME_LOGS, OUTCOME_REJECTS)])
    rows = rows.sortWithinPartitions(*parts, *LAYOUT_SORT)
    rows.write.mode("append").option("compression", "snappy").partitionBy(*parts).parquet(root)
    days = written.get
    for name, side in ((table, OUTCOME_LOGS), (quarantine_table, OUTCOME_REJECTS)):
        if stopped:
            T.recover_partitions(spark, name)
        else:
            T.add_partitions(spark, name, schemas.LOGS_APP_PARTITION, days[side])
    for done in (*stopped, mark):
        T.clear_mark(spark, done)
    counts = seen.get
    quarantined = int(counts["quarantined"])
    return IngestResult(int(counts["lines"]) - quarantined, quarantined)


@dataclass
class ServiceIngestReport:
    rows_written: int
    total_records: int
    level_distribution: list[tuple[str, int]] = field(default_factory=list)


def ingest_service_logs(
    spark: SparkSession,
    table: str,
    batch_size: int = 1000,
    *,
    seed: int = 0,
    now: dt.datetime | str | None = None,
    batch_id: str | None = None,
    fmt: str = "parquet",
) -> ServiceIngestReport:
    """Generate ``batch_size`` service-log rows, append them to ``table`` (partitioned by
    ``date_partition``), then report the table's row count and level distribution."""
    if "." in table:
        T.create_database(spark, table.rsplit(".", 1)[0])
    rows, seen = _counted(generate_service_logs(spark, batch_size, seed=seed, now=now, batch_id=batch_id), "service")
    T.append(rows, table, partition_by=[schemas.LOGS_SERVICE_PARTITION], fmt=fmt, sort_within=LAYOUT_SORT)
    stored = spark.table(table)
    total = Q.total_count(stored).first()["total_records"]
    levels = [(r["level"], r["count"]) for r in Q.level_distribution(stored).collect()]  # one row per level
    return ServiceIngestReport(int(seen.get["rows"]), int(total), levels)


def verify_source(spark: SparkSession, table: str) -> tuple[bool, int]:
    """(table exists, its row count)."""
    if not T.table_exists(spark, table):
        return False, 0
    return True, int(Q.total_count(spark.table(table)).first()["total_records"])


@dataclass
class AggregationResult:
    success: bool
    source_rows: int = 0
    statements: list[S.StatementResult] = field(default_factory=list)
    tables_written: list[str] = field(default_factory=list)
    table_counts: list[tuple[str, int]] = field(default_factory=list)


# Date-grouped summaries that can be refreshed day by day: name -> (query, date column). The
# full build and the refresh store the same columns (with the stamp), without partitions: such a
# table holds a few rows per day.
DAILY_SUMMARIES = {
    "app": {"daily_log_summary": (Q.daily_summary_loggers, schemas.LOGS_APP_PARTITION)},
    "service": {
        "daily_log_summary": (Q.daily_summary_sources_users, schemas.LOGS_SERVICE_PARTITION),
        "daily_summary": (Q.daily_level_counts, schemas.LOGS_SERVICE_PARTITION),
    },
}


SUMMARIES = {"app": Q.APP_SUMMARIES, "service": Q.SERVICE_SUMMARIES}

# Tables built (only if absent) when neither a script nor a summary kind is given.
FALLBACK_SUMMARIES = {
    "service": {"error_summary": Q.error_summary, "daily_summary": Q.daily_level_counts},
    "app": {"top_errors_by_count": Q.top_errors_by_logger, "daily_log_summary": Q.daily_summary_loggers},
}


def run_aggregation(
    spark: SparkSession,
    source_table: str,
    database: str,
    *,
    script: str | None = None,
    kind: str | None = None,
    fallback: str = "service",
    min_success_rate: float = 0.5,
    empty_script_ok: bool = False,
    fmt: str = "parquet",
    shared_scan: bool = False,
) -> AggregationResult:
    """Build the summary tables of ``database`` from ``source_table``.

    Order: check the source (missing: failure; empty: success, nothing done); then run
    ``script`` (SQL, statement by statement; failure when fewer than ``min_success_rate``
    succeed), or build the DataFrame summaries of ``kind`` (``"app"`` or ``"service"``)
    with full refresh, or, with neither, create the two ``fallback`` tables only if absent
    (``"service"``: error summary and daily counts; ``"app"``: top errors and daily summary). Ends with the row count of every table but the source.

    ``shared_scan=True``: the daily, hourly and per-logger (per-source) summaries are built from the stored
    rollup (``plans.rollups``), which reads the log table once for all of them; the results are the same, and
    ``rollups.refresh_summaries`` can go on from there day by day.
    """
    T.recover_table(spark, source_table)
    ok, rows = verify_source(spark, source_table)
    if not ok:
        return AggregationResult(False)
    if rows == 0:
        return AggregationResult(True, 0)
    result = AggregationResult(True, rows)
    T.create_database(spark, database)
    if script is not None:
        result.statements = S.run_statements(spark, script)
        result.success = S.script_passed(result.statements, min_success_rate=min_success_rate, empty_ok=empty_script_ok)
    elif kind is not None and shared_scan:
        logs = spark.table(source_table)
        rollups.refresh_rollup(spark, source_table, database, kind=kind)
        shared = rollups.rollup_summaries(spark, database, kind)
        direct = {k: v for k, v in SUMMARIES[kind].items() if k not in shared}
        result.tables_written = T.build_tables(spark, logs, database, direct | shared, fmt=fmt)
    elif kind is not None:
        result.tables_written = T.build_tables(spark, spark.table(source_table), database, SUMMARIES[kind], fmt=fmt)
    else:
        result.tables_written = T.build_tables(
            spark, spark.table(source_table), database, FALLBACK_SUMMARIES[fallback], if_exists="skip", fmt=fmt
        )
    source = source_table if "." in source_table else f"{T.current_database(spark)}.{source_table}"
    counts = T.table_row_counts(spark, database, exclude=(source, *rollups.WORKING_TABLES)).collect()  # one row per table
    result.table_counts = [(r["table_name"], int(r["row_count"])) for r in counts]
    return result


def refresh_daily_summaries(
    spark: SparkSession,
    source_table: str,
    database: str,
    *,
    kind: str = "service",
    days: int = 1,
    as_of: dt.date | str | None = None,
    fmt: str = "parquet",
    stamp: str | None = "now",
) -> list[str]:
    """Recompute the date-grouped summaries for the last ``days`` days (up to ``as_of``) and
    replace only those days' rows of the summary tables.

    The source is read with a partition filter, so a daily run reads one or two days of logs
    instead of the whole history; older summary rows are kept as they are, and a day of the window
    that has lost its log rows loses its summary rows. The summary table (a few rows per day) is
    rewritten and swapped in safely (``tables.replace_table``). A first run should cover all days (or
    use ``run_aggregation``, which stores the same shape), since absent days are not built.
    """
    from logloom.functions.predicates import within_days

    T.create_database(spark, database)
    written = []
    for name, (query, date_column) in DAILY_SUMMARIES[kind].items():
        target = f"{database}.{name}"
        inside = within_days(date_column, days, as_of)
        rows = query(spark.table(source_table).where(inside), stamp=stamp)
        T.recover_table(spark, target)
        if T.table_exists(spark, target):
            kept = spark.table(target).where(~inside | F.col(date_column).isNull())
            rows = kept.unionByName(rows, allowMissingColumns=True)
        T.replace_table(rows, target, fmt=fmt)
        written.append(target)
    return written


def table_report(spark: SparkSession, table: str, n: int = 10) -> dict[str, DataFrame]:
    """The frames of a table check: tables of its database, its columns, row count, sample
    rows and level distribution. Nothing runs until a frame is used."""
    database = table.rsplit(".", 1)[0] if "." in table else T.current_database(spark)
    df = spark.table(table)
    return {
        "tables": T.list_tables(spark, database),
        "schema": T.describe_table(spark, table),
        "count": Q.total_count(df),
        "sample": Q.sample_rows(df, n=n),
        "levels": Q.level_distribution(df),
    }
