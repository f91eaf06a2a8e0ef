"""Raw log lines and records to the curated log tables, with malformed input set aside.

Each parser produces one row per input line with a ``_reason`` column: NULL for a good row,
otherwise why the line cannot be stored. ``split_quarantine`` turns that into the two outputs,
so good + quarantined always equals the input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom import schemas
from logloom.functions import access as A
from logloom.functions.normalize import calendar_columns, day_of, record_time, simple_time, with_default
from logloom.functions.timeutil import ingest_time

REASON = "_reason"
RAW = "_raw"
FORMAT = "_format"

# ---------------------------------------------------------------------------------------------
# Quarantine reasons and reader names.
NO_MATCH = "no_match"
BAD_TIMESTAMP = "bad_timestamp"
NUMBER_OUT_OF_RANGE = "number_out_of_range"
CORRUPT_JSON = "corrupt_json"
FORMAT_ACCESS = "access"
FORMAT_JSON = "json"
# ---------------------------------------------------------------------------------------------


def access_records(lines: DataFrame, *, allow_dash_size: bool = False, column: str = "value") -> DataFrame:
    """Combined-format lines to parsed records (``timestamp`` already UTC ``timestamp_ntz``).

    Lines that do not match, whose time is invalid, or whose status or size does not fit an
    int get a ``_reason``; their fields are NULL.
    """
    pattern = A.ACCESS_LINE_PATTERN_DASH_SIZE if allow_dash_size else A.ACCESS_LINE_PATTERN
    names = A.ACCESS_GROUPS
    m = A.capture_groups(lines.select(F.col(column).alias(RAW)), RAW, pattern, names)

    def g(name: str) -> Column:
        return A.group("m", names, name)

    typed = m.select(
        F.col(RAW),
        F.col("m"),
        A.access_time(g("time")).alias("_ts"),
        g("status").try_cast("int").alias("_status"),
        A.size_value(g("size")).alias("_size"),
    )
    status = F.col("_status")
    reason = (
        F.when(F.col("m").isNull(), F.lit(NO_MATCH))
        .when(F.col("_ts").isNull(), F.lit(BAD_TIMESTAMP))
        .when(status.isNull() | F.col("_size").isNull(), F.lit(NUMBER_OUT_OF_RANGE))
    )
    failing = status >= 400
    return typed.select(
        F.col("_ts").alias("timestamp"),
        A.status_level(status).alias("level"),
        F.concat(g("method"), F.lit(" "), g("path"), F.lit(" - "), g("status")).alias("message"),
        F.lit(A.ACCESS_LOGGER).alias("logger"),
        F.lit(A.ACCESS_THREAD).alias("thread"),
        F.lit(A.ACCESS_SOURCE_FILE).alias("source_file"),
        F.lit(None).cast("int").alias("line_number"),
        F.when(failing, F.lit(A.HTTP_ERROR_CLASS)).alias("exception_class"),
        F.when(failing, F.concat(F.lit("HTTP "), g("status"))).alias("exception_message"),
        g("ip").alias("ip_address"),
        g("method").alias("http_method"),
        g("path").alias("http_path"),
        status.alias("http_status"),
        F.col("_size").alias("response_size"),
        A.dash_to_null(g("referer")).alias("referer"),
        A.dash_to_null(g("agent")).alias("user_agent"),
        F.col(RAW),
        reason.alias(REASON),
    )


def json_records(raw: DataFrame, ingest_ts: Column) -> DataFrame:
    """Rows of ``parse_json_values`` to parsed records.

    A line that is not a JSON object is quarantined. An absent time becomes the ingest time;
    a time that is present but unreadable stays NULL (the row is kept), and so does a number
    that is no number or does not fit an int (``json_int``), which then gets its default.
    """
    corrupt = F.col(schemas.CORRUPT_COLUMN)
    fields = [
        (json_int(f.name) if f.name in schemas.PARSED_INTS else F.col(f.name)).alias(f.name)
        for f in schemas.PARSED.fields
        if f.name != "timestamp"
    ]
    return raw.select(
        record_time(F.col("timestamp"), ingest_ts).alias("timestamp"),
        *fields,
        corrupt.alias(RAW),
        F.when(corrupt.isNotNull(), F.lit(CORRUPT_JSON)).alias(REASON),
    )


def parse_json_values(values: DataFrame, column: str = "value") -> DataFrame:
    """JSON text column to ``PARSED_WITH_CORRUPT`` columns, all of them text.

    Blank lines (only white space) and NULL values are no records and are skipped, as the JSON
    file reader does. Every field is read as text, so a field of another JSON type than expected
    never loses the line. What is not one JSON object keeps its text in the corrupt column: broken
    JSON, bare values, ``null``, and arrays (one line is one record).
    """
    return read_json_text(values, schemas.PARSED_WITH_CORRUPT, column)


def read_json_text(values: DataFrame, schema: StructType, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``from_json`` of the non-blank texts of ``column`` with ``schema`` (which has the corrupt
    column), after the ``keep`` columns."""
    text = F.col(column)
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT_COLUMN})
    rows = values.where(text.rlike(r"\S")).select(text.alias("_text"), parsed.alias("r"), *keep)
    corrupt = F.coalesce(F.col(f"r.{schemas.CORRUPT_COLUMN}"), F.when(F.col("r").isNull() | F.ltrim("_text").startswith("["), F.col("_text")))
    fields = [f"r.{f.name}" for f in schema.fields if f.name != schemas.CORRUPT_COLUMN]
    return rows.select(*keep, *fields, corrupt.alias(schemas.CORRUPT_COLUMN))


def json_int(column: str) -> Column:
    """A number read as text to an int: fractions are cut off; NULL when it is no number or does
    not fit."""
    text = F.col(column)
    return F.coalesce(text.try_cast("int"), text.try_cast("decimal(38,6)").try_cast("int"))


def to_logs_app(records: DataFrame, ingest_ts: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed records to the ``LOGS_APP`` columns: defaults, ingestion time, partition date;
    then the ``keep`` columns of ``records`` as they are."""
    cols = []
    for field in schemas.LOGS_APP.fields:
        name = field.name
        if name == "ingestion_timestamp":
            cols.append(ingest_ts.alias(name))
        elif name == "partition_date":
            cols.append(day_of(F.col("timestamp"), ingest_ts).alias(name))
        else:
            cols.append(with_default(name).cast(field.dataType).alias(name))
    return records.select(*cols, *keep)


def split_quarantine(records: DataFrame, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records without the helper columns, quarantined ``(format, value, reason)``).

    ``fmt`` names the input format; without it, each record's ``_format`` column is used.
    Each side keeps its rows with ``inline`` of a zero-or-one element array rather than a
    ``where``: a filter on ``_reason`` would be pushed below the parsing projection with the
    whole parse inlined into it, so every line would be parsed twice. A generator's output
    cannot be pushed through, so the parse runs once per line for each side.
    """
    fields = [c for c in records.columns if c not in (REASON, RAW, FORMAT)]
    keep = F.col(REASON).isNull()
    fmt_col = F.lit(fmt) if fmt is not None else F.col(FORMAT)
    good = records.select(F.inline(F.when(keep, F.array(F.struct(*fields)))))
    bad = records.select(
        F.inline(
            F.when(
                ~keep,
                F.array(F.struct(fmt_col.alias("format"), F.col(RAW).alias("value"), F.col(REASON).alias("reason"))),
            )
        )
    )
    return good, bad


# Single-pass layout: both outputs in one DataFrame (and one folder), told apart by ``outcome``.
OUTCOME = "outcome"
OUTCOME_LOGS = "logs"
OUTCOME_REJECTS = "rejects"


def with_outcome(records: DataFrame, columns: list[str], day: str, reject_day: Column) -> DataFrame:
    """Records with ``_reason``, ``_raw`` and ``_format`` to one row per input line that carries
    both outputs' columns: ``columns`` (NULL for a rejected line, except ``day``, which is
    ``reject_day`` there), the quarantine columns ``format``, ``value``, ``reason`` (NULL for a
    good line), and ``outcome``. Written partitioned by ``outcome``, it stores the good rows
    and the quarantine in one pass and one job."""
    keep = F.col(REASON).isNull()
    return records.select(
        *[F.when(keep, F.col(c)).alias(c) for c in columns if c != day],
        F.when(keep, F.col(day)).otherwise(reject_day).alias(day),
        F.when(~keep, F.col(FORMAT)).alias("format"),
        F.when(~keep, F.col(RAW)).alias("value"),
        F.col(REASON).alias("reason"),
        F.when(keep, F.lit(OUTCOME_LOGS)).otherwise(F.lit(OUTCOME_REJECTS)).alias(OUTCOME),
    )


def outcome_rows(records: DataFrame, ingest_ts: Column) -> DataFrame:
    """Parsed records to single-pass rows (``with_outcome``) in the ``LOGS_APP`` shape; a
    rejected line's ``partition_date`` is the ingestion day."""
    app = to_logs_app(records, ingest_ts, keep=(REASON, RAW, FORMAT))
    names = [f.name for f in schemas.LOGS_APP.fields]
    return with_outcome(app, names, schemas.LOGS_APP_PARTITION, F.to_date(ingest_ts))


def count_lines(records: DataFrame, observation: Observation) -> DataFrame:
    """Attach counts of all lines and of quarantined lines to the parsed records; they are
    filled by whichever job first runs a plan built on the result (no extra pass)."""
    return records.observe(
        observation,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col(REASON).isNotNull()).alias("quarantined"),
    )


def parse_access_logs(
    lines: DataFrame,
    *,
    allow_dash_size: bool = False,
    ingest_ts: dt.datetime | str | None = None,
    column: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """Access lines to (``LOGS_APP`` rows, quarantine)."""
    good, bad = split_quarantine(access_records(lines, allow_dash_size=allow_dash_size, column=column), FORMAT_ACCESS)
    return to_logs_app(good, ingest_time(ingest_ts)), bad


def parse_json_logs(raw: DataFrame, *, ingest_ts: dt.datetime | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the permissive JSON reader to (``LOGS_APP`` rows, quarantine)."""
    ingest = ingest_time(ingest_ts)
    good, bad = split_quarantine(json_records(raw, ingest), FORMAT_JSON)
    return to_logs_app(good, ingest), bad


def access_table(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Access lines to the ``ACCESS_LOGS`` table shape (ident/user/protocol kept, calendar
    partition columns filled), and the quarantine."""
    names = A.ACCESS_TABLE_GROUPS
    m = A.capture_groups(lines.select(F.col(column).alias(RAW)), RAW, A.ACCESS_TABLE_PATTERN, names)

    def g(name: str) -> Column:
        return A.group("m", names, name)

    typed = m.select(
        F.col(RAW),
        F.col("m"),
        A.access_time(g("time")).alias("_ts"),
        g("status").try_cast("int").alias("_status"),
        A.size_value(g("size")).alias("_size"),
    )
    ts, status, size = F.col("_ts"), F.col("_status"), F.col("_size")
    reason = (
        F.when(F.col("m").isNull(), F.lit(NO_MATCH))
        .when(ts.isNull(), F.lit(BAD_TIMESTAMP))
        .when(status.isNull() | size.isNull(), F.lit(NUMBER_OUT_OF_RANGE))
    )
    records = typed.select(
        ts.alias("timestamp"),
        g("ip").alias("remote_ip"),
        A.dash_to_null(g("user")).alias("remote_user"),
        g("method").alias("method"),
        g("url").alias("url"),
        g("protocol").alias("protocol"),
        status.alias("status"),
        size.alias("size"),
        A.dash_to_null(g("referer")).alias("referer"),
        A.dash_to_null(g("agent")).alias("user_agent"),
        *calendar_columns(ts),
        F.col(RAW),
        reason.alias(REASON),
    )
    return split_quarantine(records, FORMAT_ACCESS)


def to_logs_simple(
    records: DataFrame,
    *,
    time_column: str = "timestamp_str",
    fmt: str = "yyyy-MM-dd HH:mm:ss",
    ingest_ts: dt.datetime | str | None = None,
    zone: str | None = "UTC",
) -> DataFrame:
    """Rows with a text time (``time_column``), level, service, message and metadata to the
    ``LOGS_SIMPLE`` shape: the text is parsed (NULL when unreadable) as wall-clock time in
    ``zone`` (``None``: the session zone; see ``simple_time``) and dropped, and the ingestion
    time is added. ``metadata`` stays JSON text."""
    return records.select(
        simple_time(F.col(time_column), fmt, zone).alias("timestamp"),
        "level",
        "service",
        "message",
        "metadata",
        ingest_time(ingest_ts).alias("ingestion_time"),
    )
