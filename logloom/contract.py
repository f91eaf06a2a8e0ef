"""Named queries over the test tables, one per operator family, for the correctness check.

Every callable takes ``(spark, sf_dir)``, reads the test tables (the log input is derived
from ``events``) and returns a DataFrame with deterministic content: relative dates use
``AS_OF``, ingestion times use ``INGEST_TS``, and every top-N ordering has tie-breaks. The
matching DuckDB statements are in ``logloom.oracle``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import parse as parse_ops
from logloom.operators import summaries as Q
from logloom.plans import batches, pipelines, rollups, tables
from logloom.plans import script as script_ops
from logloom.session import shared_dir
from logloom.sources.events import (
    event_access_lines,
    event_json_lines,
    event_logs,
    event_simple_records,
    read_events,
)
from logloom.functions.normalize import stamp_batch
from logloom.sources.files import read_json_logs, read_lake, read_logs, read_outcome, read_table
from logloom.streaming import ingest as stream_ops

# ---------------------------------------------------------------------------------------------
# Fixed values of the check: the "today" of relative-date queries, and the ingestion time.
AS_OF = "2024-01-30"
INGEST_TS = "2024-01-31 00:00:00"
BATCH_ID = "batch-0001"
# ---------------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log table (both curated shapes' columns)."""
    return event_logs(read_events(spark, sf_dir))


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``LOGS_APP`` rows parsed from the derived access lines."""
    good, _ = parse_ops.parse_access_logs(event_access_lines(read_events(spark, sf_dir)), ingest_ts=INGEST_TS)
    return good


def _on_logs(fn, **kw) -> Query:
    return lambda spark, sf_dir: fn(logs(spark, sf_dir), **kw)


def _on_access(fn, **kw) -> Query:
    return lambda spark, sf_dir: fn(access_logs(spark, sf_dir), **kw)


def _on_rollup(fn, **kw) -> Query:
    """A summary built from the hourly rollup of the derived logs (shared-scan form)."""
    return lambda spark, sf_dir: fn(Q.hourly_logger_rollup(logs(spark, sf_dir)), **kw)


def exception_summary_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 with the sorted logger array joined by ``|`` (plain values for the hash check)."""
    out = Q.exception_summary(logs(spark, sf_dir))
    return out.withColumn("affected_loggers", F.array_join("affected_loggers", "|"))


LOG_COLUMNS = ("timestamp", "level", "message", "logger", "source", "user_id", "session_id", "ip_address")


def access_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = parse_ops.parse_access_logs(event_access_lines(read_events(spark, sf_dir)), ingest_ts=INGEST_TS)
    return bad


def access_quarantine_dash_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = parse_ops.parse_access_logs(
        event_access_lines(read_events(spark, sf_dir)), allow_dash_size=True, ingest_ts=INGEST_TS
    )
    return bad


def access_logs_dash_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse_ops.parse_access_logs(
        event_access_lines(read_events(spark, sf_dir)), allow_dash_size=True, ingest_ts=INGEST_TS
    )
    return good


def access_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse_ops.access_table(event_access_lines(read_events(spark, sf_dir)))
    return good


def queries() -> dict[str, Query]:
    return {
        # Summary queries (Q1-Q20, Q22)
        "top_errors_by_logger": _on_logs(Q.top_errors_by_logger),
        "top_errors_by_source": _on_logs(Q.top_errors_by_source),
        "daily_summary_loggers": _on_logs(Q.daily_summary_loggers),
        "daily_summary_sources_users": _on_logs(Q.daily_summary_sources_users),
        "hourly_error_trends_loggers": _on_logs(Q.hourly_error_trends_loggers),
        "hourly_error_trends_sources": _on_logs(Q.hourly_error_trends_sources),
        "logger_activity_summary": _on_logs(Q.logger_activity_summary),
        "source_activity_summary": _on_logs(Q.source_activity_summary),
        "exception_summary": exception_summary_flat,
        "user_activity_summary": _on_logs(Q.user_activity_summary),
        "ip_address_analysis": _on_logs(Q.ip_address_analysis),
        "error_summary": _on_logs(Q.error_summary),
        "daily_level_counts": _on_logs(Q.daily_level_counts),
        "level_distribution": _on_logs(Q.level_distribution),
        "total_count": _on_logs(Q.total_count),
        "latest_rows": _on_logs(Q.latest_rows, columns=LOG_COLUMNS),
        "sample_rows": _on_logs(Q.sample_rows, columns=LOG_COLUMNS, order_by=LOG_COLUMNS),
        "level_overview_recent": _on_logs(Q.level_overview_recent, as_of=AS_OF),
        "top_error_loggers_recent": _on_logs(Q.top_error_loggers_recent, as_of=AS_OF),
        "http_traffic": _on_access(Q.http_traffic, as_of=AS_OF),
        "top_paths": _on_access(Q.top_paths),
        # Q3, Q5, Q7 from one shared hourly rollup (the summary job's shared_scan=True)
        "daily_summary_loggers_rollup": _on_rollup(Q.daily_summary_loggers_from_rollup),
        "hourly_error_trends_loggers_rollup": _on_rollup(Q.hourly_error_trends_loggers_from_rollup),
        "logger_activity_summary_rollup": _on_rollup(Q.logger_activity_summary_from_rollup),
        # Parsing and normalisation of access lines (P1, P4, P7-P17)
        "parse_access_lines": access_logs,
        "access_quarantine": access_quarantine,
        "parse_access_lines_dash_size": access_logs_dash_size,
        "access_quarantine_dash_size": access_quarantine_dash_size,
        "access_table": access_table,
        **write_queries(),
    }


# --- Queries that write and read back (sources, sinks, jobs, streams) ---------------------------
# They write below the cluster's shared checkpoint folder (``spark.checkpoint.dir``), each
# call in a fresh folder, and return the data read back.

ACCESS_SUBDIR_GLOB = "access/*.txt"
JSON_SUBDIR_GLOB = "json/*.txt"
STREAM_COLUMNS = ("timestamp", "level", "message", "logger", "thread", "partition_date")


# What the queries of this process have left behind, for ``clean_up``; and the raw files by input.
_FOLDERS: list[str] = []
_DATABASES: list[str] = []
_VIEWS: list[str] = []
_RAW: dict[tuple[str, str], str] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    _FOLDERS.append(shared_dir(spark, "logloom-contract", name))
    return _FOLDERS[-1]


def write_raw(spark: SparkSession, sf_dir: str) -> str:
    """Raw access lines and JSON lines derived from ``events``, written as text files once per
    application and input; the queries only read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RAW:
        prefix = _scratch(spark, "raw")
        events = read_events(spark, sf_dir)
        event_access_lines(events).write.text(f"{prefix}/access")
        event_json_lines(events).write.text(f"{prefix}/json")
        _RAW[key] = prefix
    return _RAW[key]


def clean_up(spark: SparkSession) -> None:
    """Drop the databases and views and delete the folders that earlier queries made. Call it when
    their results have been consumed: a result may still read them."""
    for name in _VIEWS:
        spark.catalog.dropTempView(name)
    for name in _DATABASES:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in _FOLDERS:
        place = path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    for made in (_VIEWS, _DATABASES, _FOLDERS, _RAW):
        made.clear()


def _json_parsed(spark: SparkSession, sf_dir: str):
    prefix = write_raw(spark, sf_dir)
    return parse_ops.parse_json_logs(read_json_logs(spark, prefix, JSON_SUBDIR_GLOB), ingest_ts=INGEST_TS)


def json_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-lines files -> permissive reader -> ``LOGS_APP`` rows."""
    return _json_parsed(spark, sf_dir)[0]


def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-lines files -> the lines that are not JSON objects."""
    return _json_parsed(spark, sf_dir)[1]


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text column (no files) -> ``from_json`` -> ``LOGS_APP`` rows."""
    values = event_json_lines(read_events(spark, sf_dir))
    return parse_ops.parse_json_logs(parse_ops.parse_json_values(values), ingest_ts=INGEST_TS)[0]


def mixed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with both kinds of files -> both parsed and unioned."""
    prefix = write_raw(spark, sf_dir)
    good, _ = read_logs(spark, prefix, ingest_ts=INGEST_TS, access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB)
    return good


def mixed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = write_raw(spark, sf_dir)
    _, bad = read_logs(spark, prefix, ingest_ts=INGEST_TS, access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB)
    return bad


def _database(spark: SparkSession) -> str:
    name = "logloom_" + uuid.uuid4().hex[:12]
    tables.create_database(spark, name, location=_scratch(spark, name))
    _DATABASES.append(name)
    return name


def ingest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ingest job into a new partitioned table (rejects to a second table), then the
    table read back."""
    prefix = write_raw(spark, sf_dir)
    db = _database(spark)
    pipelines.ingest_logs(
        spark, prefix, f"{db}.logs", ingest_ts=INGEST_TS, quarantine_table=f"{db}.rejects",
        access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB,
    )
    return read_table(spark, f"{db}.logs").select(*[f.name for f in schemas.LOGS_APP.fields])


def _single_pass(spark: SparkSession, sf_dir: str) -> str:
    """Batch ingest in one pass into a log table and a quarantine table stored side by side."""
    prefix = write_raw(spark, sf_dir)
    db = _database(spark)
    pipelines.ingest_logs_single_pass(
        spark, prefix, f"{db}.logs", f"{db}.rejects", _scratch(spark, "lake"), ingest_ts=INGEST_TS,
        access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB,
    )
    return db


def ingest_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-pass ingest job, then the log table read back."""
    db = _single_pass(spark, sf_dir)
    return read_table(spark, f"{db}.logs").select(*[f.name for f in schemas.LOGS_APP.fields])


def ingest_single_pass_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-pass ingest job, then the quarantine table read back (its ingestion-day column left out)."""
    db = _single_pass(spark, sf_dir)
    return read_table(spark, f"{db}.rejects").select(*[f.name for f in schemas.QUARANTINE.fields])


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-stream ingest with an availableNow trigger, run twice (the second run finds
    nothing new), then the sink read back. ``ingestion_timestamp`` (the batch time) is left
    out."""
    prefix = write_raw(spark, sf_dir)
    sink, ck = _scratch(spark, "sink"), _scratch(spark, "checkpoint")
    for _ in range(2):
        stream_ops.incremental_ingest(
            spark, prefix, sink, ck, access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB, ingest_ts=INGEST_TS
        )
    cols = [f.name for f in schemas.LOGS_APP.fields if f.name != "ingestion_timestamp"]
    return spark.read.parquet(sink).select(*cols)


def _incremental_single_pass(spark: SparkSession, sf_dir: str) -> str:
    """File-stream ingest of both outputs in one query (run twice; the second finds nothing)."""
    prefix = write_raw(spark, sf_dir)
    sink, ck = _scratch(spark, "single-pass-sink"), _scratch(spark, "single-pass-checkpoint")
    for _ in range(2):
        stream_ops.incremental_ingest(
            spark, prefix, sink, ck, access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB, single_pass=True,
            ingest_ts=INGEST_TS,
        )
    return sink


def incremental_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-query incremental ingest, the log side read back (batch time left out)."""
    sink = _incremental_single_pass(spark, sf_dir)
    cols = [f.name for f in schemas.LOGS_APP.fields if f.name != "ingestion_timestamp"]
    return read_outcome(spark, sink, parse_ops.OUTCOME_LOGS).select(*cols)


def incremental_single_pass_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-query incremental ingest, the quarantine side read back (its day left out)."""
    sink = _incremental_single_pass(spark, sf_dir)
    return read_outcome(spark, sink, parse_ops.OUTCOME_REJECTS).select(*[f.name for f in schemas.QUARANTINE.fields])


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values from a file stream -> ``from_json`` -> watermark -> partitioned Parquet
    sink, run to the end of the input; then the sink read back."""
    prefix = write_raw(spark, sf_dir)
    sink, ck = _scratch(spark, "stream-sink"), _scratch(spark, "stream-checkpoint")
    values = stream_ops.stream_source(spark, f"{prefix}/{JSON_SUBDIR_GLOB}")
    for q in stream_ops.streaming_ingest(values, sink, ck, trigger="availableNow", ingest_ts=INGEST_TS):
        q.awaitTermination()
    return spark.read.parquet(sink).select(*STREAM_COLUMNS)


def _stream_single_pass(spark: SparkSession, sf_dir: str) -> str:
    """The value stream with both outputs written by one query, run to the end of the input."""
    prefix = write_raw(spark, sf_dir)
    sink, ck = _scratch(spark, "stream-single-pass"), _scratch(spark, "stream-single-pass-checkpoint")
    values = stream_ops.stream_source(spark, f"{prefix}/{JSON_SUBDIR_GLOB}")
    for q in stream_ops.streaming_ingest(values, sink, ck, trigger="availableNow", single_pass=True, ingest_ts=INGEST_TS):
        q.awaitTermination()
    return sink


def stream_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-query value stream, the log side read back."""
    sink = _stream_single_pass(spark, sf_dir)
    return read_outcome(spark, sink, parse_ops.OUTCOME_LOGS, logs_schema=schemas.STREAM_LOGS).select(*STREAM_COLUMNS)


def stream_single_pass_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-query value stream, the quarantine side read back (its day left out)."""
    sink = _stream_single_pass(spark, sf_dir)
    rejects = read_outcome(spark, sink, parse_ops.OUTCOME_REJECTS, logs_schema=schemas.STREAM_LOGS)
    return rejects.select(*[f.name for f in schemas.QUARANTINE.fields])


def _service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived logs in the ``LOGS_SERVICE`` shape (fixed ingest time and batch id)."""
    df = stamp_batch(logs(spark, sf_dir), BATCH_ID, INGEST_TS)
    return df.select(*[f.name for f in schemas.LOGS_SERVICE.fields])


def service_lake_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service logs written to a date-partitioned folder, read back for the last 7 days
    (only those partitions are listed and read)."""
    path = _scratch(spark, "service-lake")
    tables.overwrite_path(_service_logs(spark, sf_dir), path, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    return read_lake(
        spark, path, date_column=schemas.LOGS_SERVICE_PARTITION, days=7, as_of=AS_OF, schema=schemas.LOGS_SERVICE
    )


def _service_source(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    db = _database(spark)
    source = f"{db}.logs"
    tables.append(_service_logs(spark, sf_dir), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    return db, source


# What is compared of each summary table: the group (as one text), two counts, and the first and latest time.
SERVICE_CONTENTS = {
    "top_errors_by_count": (("level", "source", "message"), "error_count", None, "first_occurrence", "latest_occurrence"),
    "daily_log_summary": (("date_partition", "level"), "log_count", "unique_users", None, None),
    "hourly_error_trends": (("hour", "level"), "error_count", "unique_sources", None, None),
    "source_activity_summary": (("source",), "total_logs", "debug_count", "first_log", "latest_log"),
    "user_activity_summary": (("user_id",), "total_activity", "unique_sessions", "first_activity", "latest_activity"),
    "ip_address_analysis": (("ip_address",), "total_requests", "unique_users", "first_request", "latest_request"),
}
FALLBACK_CONTENTS = {
    "error_summary": (("level", "source"), "error_count", None, None, "latest_occurrence"),
    "daily_summary": (("date_partition", "level"), "log_count", None, None, None),
}
APP_CONTENTS = {
    "top_errors_by_count": (("level", "logger", "message"), "error_count", None, "first_occurrence", "latest_occurrence"),
    "daily_log_summary": (("partition_date", "level"), "log_count", "unique_loggers", None, None),
    "hourly_error_trends": (("hour", "level"), "error_count", "unique_loggers", None, None),
    "logger_activity_summary": (("logger",), "total_logs", "error_count", "first_log", "latest_log"),
    "exception_summary": (("exception_class", "exception_type"), "occurrence_count", None, None, "latest_occurrence"),
}


def _contents(spark: SparkSession, db: str, spec) -> DataFrame:
    """The rows of all summary tables of ``db`` as (table_name, item, n, m, first, latest); the tables are those
    of ``spec`` and no others."""
    found = {r["table_name"] for r in tables.table_row_counts(spark, db, exclude=(f"{db}.logs", *rollups.WORKING_TABLES)).collect()}
    if found != set(spec):
        raise RuntimeError(f"tables {sorted(found)} instead of {sorted(spec)}")
    parts = [
        spark.table(f"{db}.{name}").select(
            F.lit(name).alias("table_name"),
            F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]).alias("item"),
            F.col(n).cast("long").alias("n"),
            (F.col(m) if m else F.lit(0)).cast("long").alias("m"),
            (F.col(first) if first else F.lit(None)).cast("timestamp_ntz").alias("first"),
            (F.col(latest) if latest else F.lit(None)).cast("timestamp_ntz").alias("latest"),
        )
        for name, (keys, n, m, first, latest) in spec.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def aggregation_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary job over a service-log table: all service summaries (full refresh); their contents."""
    db, source = _service_source(spark, sf_dir)
    if not pipelines.run_aggregation(spark, source, db, kind="service").success:
        raise RuntimeError("aggregation failed")
    return _contents(spark, db, SERVICE_CONTENTS)


def service_shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service summaries with the daily, hourly and per-source tables from one rollup; their contents."""
    db, source = _service_source(spark, sf_dir)
    if not pipelines.run_aggregation(spark, source, db, kind="service", shared_scan=True).success:
        raise RuntimeError("aggregation failed")
    return _contents(spark, db, SERVICE_CONTENTS)


def aggregation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary job with neither script nor kind: error summary and daily counts, created only if
    absent. The job runs twice, and the source doubles in between: the contents are the first run's."""
    db, source = _service_source(spark, sf_dir)
    pipelines.run_aggregation(spark, source, db)
    tables.append(_service_logs(spark, sf_dir), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    pipelines.run_aggregation(spark, source, db)
    return _contents(spark, db, FALLBACK_CONTENTS)


def app_summary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application-log table -> the application summaries as tables -> their contents."""
    db = _database(spark)
    source = f"{db}.logs"
    app = logs(spark, sf_dir).select(
        "timestamp", "level", "message", "logger", "exception_class", "exception_message", "partition_date"
    )
    tables.append(app, source, partition_by=[schemas.LOGS_APP_PARTITION])
    if not pipelines.run_aggregation(spark, source, db, kind="app", shared_scan=True).success:
        raise RuntimeError("aggregation failed")
    return _contents(spark, db, APP_CONTENTS)


def aggregate_then_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full build from the logs before 2024-01-20, the rest appended, the last days refreshed: the
    stored daily summary equals a full rebuild."""
    db = _database(spark)
    source = f"{db}.logs"
    service = _service_logs(spark, sf_dir)
    cut = F.col("date_partition") < F.lit("2024-01-20").cast("date")
    tables.append(service.where(cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    pipelines.run_aggregation(spark, source, db, kind="service")
    tables.append(service.where(~cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    pipelines.refresh_daily_summaries(spark, source, db, days=11, as_of="2024-01-30")
    return spark.table(f"{db}.daily_log_summary").drop("aggregation_timestamp")


def script_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregation job run by a script of which three of four statements succeed: its verdict at
    two success rates, and the rows of the table that the script writes."""
    db, source = _service_source(spark, sf_dir)
    script = f"""
    CREATE TABLE {db}.errors USING parquet AS SELECT source, count(*) AS n FROM {source} WHERE level = 'ERROR' GROUP BY source;
    SELECT * FROM {db}.absent; SELECT count(*) FROM {source}; SELECT level FROM {source} GROUP BY level
    """
    verdicts = []
    for rate in (0.5, 0.9):
        spark.sql(f"DROP TABLE IF EXISTS {db}.errors")
        verdicts.append(pipelines.run_aggregation(spark, source, db, script=script, min_success_rate=rate).success)
    return spark.table(f"{db}.errors").select("source", "n", F.lit(verdicts[0]).alias("passed_half"), F.lit(verdicts[1]).alias("passed_nine_tenths"))


def recreated_access_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar-partitioned access table, filled, dropped and created empty, filled again."""
    table = f"{_database(spark)}.access"
    for _ in range(2):
        tables.recreate_table(spark, table, schemas.ACCESS_LOGS, partition_by=schemas.ACCESS_LOGS_PARTITION)
        tables.append(access_table(spark, sf_dir), table, partition_by=schemas.ACCESS_LOGS_PARTITION)
    return read_table(spark, table).select(*schemas.ACCESS_LOGS.names)


def table_with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple logs appended to a table created with properties; each row with a property read back."""
    table = f"{_database(spark)}.simple"
    tables.create_table(spark, table, schemas.LOGS_SIMPLE, properties={"owner_team": "observability"})
    tables.append(parse_ops.to_logs_simple(event_simple_records(read_events(spark, sf_dir)), ingest_ts=INGEST_TS), table)
    owner = spark.sql(f"SHOW TBLPROPERTIES {table} ('owner_team')").first()["value"]
    return read_table(spark, table).withColumn("owner_team", F.lit(owner))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of a freshly written database, with the rows of each table."""
    db, _ = _service_source(spark, sf_dir)
    rows = {r["table_name"]: r["row_count"] for r in tables.table_row_counts(spark, db, exclude=()).collect()}
    listed = [r["tableName"] for r in tables.list_tables(spark, db).where("not isTemporary").collect()]
    parts = [
        tables.describe_table(spark, f"{db}.{name}").where("col_name NOT LIKE '#%'").dropDuplicates(["col_name"])
        .select(F.lit(name).alias("table_name"), "col_name", "data_type", F.lit(rows[name]).cast("long").alias("row_count"))
        for name in listed
    ]
    return reduce(DataFrame.unionByName, parts)


def table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table report over a derived table: each level's count beside the total."""
    _, source = _service_source(spark, sf_dir)
    report = pipelines.table_report(spark, source)
    if report["sample"].count() != 10 or report["tables"].where("not isTemporary").count() != 1 or not report["schema"].count():
        raise RuntimeError("the report is not complete")
    total = report["count"].first()["total_records"]
    return report["levels"].withColumn("total_records", F.lit(total).cast("long"))


def late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental ingest of JSON files, of which the older half (by file time, 30 days back)
    arrives after the newer half: all rows are there."""
    early, late = _scratch(spark, "early"), _scratch(spark, "late")
    events = read_events(spark, sf_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for prefix, half in ((early, 0), (late, 1)):
        event_json_lines(events.where(F.col("event_id") % 2 == half)).write.text(f"{prefix}/json")
    folder = path(f"{late}/json")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = int(time.time() * 1000) - 30 * 86_400_000
    sink, ck = _scratch(spark, "late-sink"), _scratch(spark, "late-checkpoint")
    run = {"access_glob": "none/*.log", "json_glob": "json/*.txt", "ingest_ts": INGEST_TS}
    stream_ops.incremental_ingest(spark, early, sink, ck, **run)
    for status in fs.listStatus(folder):
        fs.setTimes(status.getPath(), old, -1)
        fs.rename(status.getPath(), path(f"{early}/json/late-{status.getPath().getName()}"))
    stream_ops.incremental_ingest(spark, early, sink, ck, **run)
    return spark.read.parquet(sink).select(*[f.name for f in schemas.LOGS_APP.fields if f.name != "ingestion_timestamp"])


def repeated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch ingest run twice with one batch id, after a first, different attempt of that batch (the JSON
    lines alone): the table equals one run."""
    prefix = write_raw(spark, sf_dir)
    db = _database(spark)
    for access in ("none/*.log", ACCESS_SUBDIR_GLOB, ACCESS_SUBDIR_GLOB):
        pipelines.ingest_logs(
            spark, prefix, f"{db}.logs", ingest_ts=INGEST_TS, batch_id="batch-7", access_glob=access, json_glob=JSON_SUBDIR_GLOB
        )
    return read_table(spark, f"{db}.logs").select(*[f.name for f in schemas.LOGS_APP.fields])


def repeated_batch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejects of a batch that was ingested twice."""
    prefix = write_raw(spark, sf_dir)
    db = _database(spark)
    for _ in range(2):
        pipelines.ingest_logs(
            spark, prefix, f"{db}.logs", ingest_ts=INGEST_TS, batch_id="batch-7", access_glob=ACCESS_SUBDIR_GLOB, json_glob=JSON_SUBDIR_GLOB
        )
    return read_table(spark, f"{db}.logs_rejects").select(*[f.name for f in schemas.QUARANTINE.fields])


def ledger_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arriving in two steps, ingested by the ledger in batches of two files; a batch is run once
    more, as after a cut-off run. All rows are there once."""
    raw, ledger = _scratch(spark, "ledger-raw"), _scratch(spark, "ledger")
    events = read_events(spark, sf_dir)
    db = _database(spark)
    run = {"access_glob": "none/*.log", "json_glob": "json/*/*.txt", "ingest_ts": INGEST_TS, "max_files": 2}
    for half in (0, 1):
        event_json_lines(events.where(F.col("event_id") % 2 == half)).repartition(3).write.text(f"{raw}/json/part{half}")
        done = batches.ingest_new_files(spark, raw, f"{db}.logs", ledger, **run)
    batches.run_batch(spark, done[-1].batch, f"{db}.logs", ledger, ingest_ts=INGEST_TS)
    return spark.table(f"{db}.logs").select(*[f.name for f in schemas.LOGS_APP.fields])


def latest_rows_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a stored table, found by its partitions."""
    _, source = _service_source(spark, sf_dir)
    columns = tuple(c for c in LOG_COLUMNS if c != "logger")
    return Q.latest_rows_of_table(spark, source, date_column=schemas.LOGS_SERVICE_PARTITION, columns=columns)


def hourly_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application logs (JSON lines, some without a time): summaries built through the rollup from the days
    before 2024-01-20, the rest appended, the last days refreshed. The stored hourly summary equals a full
    rebuild."""
    db = _database(spark)
    source = f"{db}.logs"
    app = json_logs(spark, sf_dir)
    cut = F.col("partition_date") < F.lit("2024-01-20").cast("date")
    tables.append(app.where(cut), source, partition_by=[schemas.LOGS_APP_PARTITION])
    rollups.refresh_summaries(spark, source, db, kind="app", days=None)
    tables.append(app.where(~cut), source, partition_by=[schemas.LOGS_APP_PARTITION])
    rollups.refresh_summaries(spark, source, db, kind="app", days=12, as_of="2024-01-31")
    return spark.table(f"{db}.hourly_error_trends").drop("aggregation_timestamp")


def _service_rollup(spark: SparkSession, sf_dir: str) -> str:
    """Service summaries through the rollup, in two steps as ``hourly_refresh``."""
    db = _database(spark)
    source = f"{db}.logs"
    service = _service_logs(spark, sf_dir)
    cut = F.col("date_partition") < F.lit("2024-01-20").cast("date")
    tables.append(service.where(cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    rollups.refresh_summaries(spark, source, db, days=None)
    tables.append(service.where(~cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    rollups.refresh_summaries(spark, source, db, days=11, as_of="2024-01-30")
    return db


def users_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refreshed daily summary, its distinct users from the days' bitmaps."""
    return spark.table(f"{_service_rollup(spark, sf_dir)}.daily_log_summary").drop("aggregation_timestamp")


def window_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users per level over a week, merged from the days' bitmaps."""
    return rollups.window_users(spark, _service_rollup(spark, sf_dir), as_of=AS_OF)


def replaced_partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date-partitioned table replaced twice by the pointer change, at last from itself."""
    table = f"{_database(spark)}.service"
    rows = _service_logs(spark, sf_dir)
    by = [schemas.LOGS_SERVICE_PARTITION]
    tables.replace_table(rows.where("level = 'ERROR'"), table, partition_by=by)
    tables.replace_table(rows, table, partition_by=by)
    tables.replace_table(spark.table(table).where("level <> 'DEBUG'"), table, partition_by=by)
    return spark.table(table).select(*schemas.LOGS_SERVICE.names)


# Statements of the script check. The third one fails (unknown table); the rest succeed.
SCRIPT = """
-- error rows of the derived logs
CREATE OR REPLACE TEMPORARY VIEW {errors} AS
SELECT * FROM {logs} WHERE level IN ('ERROR', 'WARN');
SELECT level, logger, message, COUNT(*) AS error_count FROM {errors} GROUP BY level, logger, message;
SELECT * FROM {missing};
/* loggers; a ';' inside a comment or 'a string;' does not split */
SELECT logger, COUNT(*) AS n, 'x;y' AS s FROM {logs} GROUP BY logger;
"""


def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL script over the derived logs, run statement by statement -> per-statement report."""
    suffix = uuid.uuid4().hex[:8]
    names = {"logs": f"logs_{suffix}", "errors": f"errors_{suffix}", "missing": f"missing_{suffix}"}
    logs(spark, sf_dir).createOrReplaceTempView(names["logs"])
    _VIEWS.extend([names["logs"], names["errors"]])
    results = script_ops.run_statements(spark, SCRIPT.format(**names))
    return script_ops.report_frame(spark, results).select("statement_index", "row_count", "success")


def simple_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-log rows with text times -> parsed -> a replaced (create-or-replace) table,
    read back."""
    table = f"{_database(spark)}.simple_logs"
    rows = parse_ops.to_logs_simple(event_simple_records(read_events(spark, sf_dir)), ingest_ts=INGEST_TS)
    tables.replace_table(rows, table)
    return read_table(spark, table)


def write_queries() -> dict[str, Query]:
    return {
        "json_logs": json_logs,
        "json_quarantine": json_quarantine,
        "json_values": json_values,
        "mixed_logs": mixed_logs,
        "mixed_quarantine": mixed_quarantine,
        "ingest_job": ingest_job,
        "ingest_single_pass": ingest_single_pass,
        "ingest_single_pass_rejects": ingest_single_pass_rejects,
        "incremental_ingest": incremental_ingest,
        "incremental_single_pass": incremental_single_pass,
        "incremental_single_pass_rejects": incremental_single_pass_rejects,
        "stream_ingest": stream_ingest,
        "stream_single_pass": stream_single_pass,
        "stream_single_pass_rejects": stream_single_pass_rejects,
        "service_lake_recent": service_lake_recent,
        "aggregation_service": aggregation_service,
        "service_shared_scan": service_shared_scan,
        "aggregation_fallback": aggregation_fallback,
        "app_summary_tables": app_summary_tables,
        "aggregate_then_refresh": aggregate_then_refresh,
        "script_verdict": script_verdict,
        "recreated_access_table": recreated_access_table,
        "table_with_properties": table_with_properties,
        "catalog_listing": catalog_listing,
        "table_check": table_check,
        "late_files": late_files,
        "repeated_batch": repeated_batch,
        "repeated_batch_rejects": repeated_batch_rejects,
        "ledger_ingest": ledger_ingest,
        "latest_rows_stored": latest_rows_stored,
        "hourly_refresh": hourly_refresh,
        "users_refresh": users_refresh,
        "window_users": window_users,
        "replaced_partitioned_table": replaced_partitioned_table,
        "sql_script": sql_script,
        "daily_refresh": daily_refresh,
        "simple_logs": simple_logs,
    }


def daily_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries built from the logs before 2024-01-20, then the rest of the logs
    appended and only the days from 2024-01-19 on recomputed (dynamic partition overwrite);
    the table read back equals a full rebuild."""
    db = _database(spark)
    source = f"{db}.logs"
    service = _service_logs(spark, sf_dir)
    cut = F.col("date_partition") < F.lit("2024-01-20").cast("date")
    tables.append(service.where(cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    pipelines.refresh_daily_summaries(spark, source, db, days=10_000, as_of="2024-01-19")
    tables.append(service.where(~cut), source, partition_by=[schemas.LOGS_SERVICE_PARTITION])
    pipelines.refresh_daily_summaries(spark, source, db, days=11, as_of="2024-01-30")
    return spark.table(f"{db}.daily_log_summary").drop("aggregation_timestamp")
