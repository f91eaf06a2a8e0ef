"""The declared schemas. Every reader uses one of these; nothing is inferred.

All columns are nullable. Timestamps in the curated tables are ``timestamp_ntz`` holding UTC
wall-clock time: the parsers convert every offset to UTC first, so the stored value is an
instant, and it compares equal to a plain SQL ``TIMESTAMP`` in other engines.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


# One raw text line per row.
RAW_TEXT = _schema(("value", StringType()))

# A parsed record before normalisation: the 16 fields of an application-log JSON line
# (the access-line parser produces the same fields). ``timestamp`` is still text.
PARSED = _schema(
    ("timestamp", StringType()),
    ("level", StringType()),
    ("message", StringType()),
    ("logger", StringType()),
    ("thread", StringType()),
    ("source_file", StringType()),
    ("line_number", IntegerType()),
    ("exception_class", StringType()),
    ("exception_message", StringType()),
    ("ip_address", StringType()),
    ("http_method", StringType()),
    ("http_path", StringType()),
    ("http_status", IntegerType()),
    ("response_size", IntegerType()),
    ("referer", StringType()),
    ("user_agent", StringType()),
)

# Numeric fields of a JSON record; like all its fields they are read as text, then cast.
PARSED_INTS = ("line_number", "http_status", "response_size")

CORRUPT_COLUMN = "_corrupt_record"
PARSED_WITH_CORRUPT = StructType([StructField(name, StringType(), True) for name in (*PARSED.names, CORRUPT_COLUMN)])

# The curated application-log table, partitioned by ``partition_date``.
LOGS_APP = _schema(
    ("timestamp", TimestampNTZType()),
    ("level", StringType()),
    ("message", StringType()),
    ("logger", StringType()),
    ("thread", StringType()),
    ("source_file", StringType()),
    ("line_number", IntegerType()),
    ("exception_class", StringType()),
    ("exception_message", StringType()),
    ("ingestion_timestamp", TimestampNTZType()),
    ("partition_date", DateType()),
    ("ip_address", StringType()),
    ("http_method", StringType()),
    ("http_path", StringType()),
    ("http_status", IntegerType()),
    ("response_size", IntegerType()),
    ("referer", StringType()),
    ("user_agent", StringType()),
)
LOGS_APP_PARTITION = "partition_date"

# The curated service-log table, partitioned by ``date_partition``.
LOGS_SERVICE = _schema(
    ("timestamp", TimestampNTZType()),
    ("level", StringType()),
    ("message", StringType()),
    ("source", StringType()),
    ("user_id", StringType()),
    ("session_id", StringType()),
    ("ip_address", StringType()),
    ("ingested_at", TimestampNTZType()),
    ("batch_id", StringType()),
    ("date_partition", DateType()),
)
LOGS_SERVICE_PARTITION = "date_partition"

# Simple logs: ``metadata`` is JSON text that is stored, never unpacked.
LOGS_SIMPLE = _schema(
    ("timestamp", TimestampNTZType()),
    ("level", StringType()),
    ("service", StringType()),
    ("message", StringType()),
    ("metadata", StringType()),
    ("ingestion_time", TimestampNTZType()),
)

# Access-log table with calendar partition columns.
ACCESS_LOGS = _schema(
    ("timestamp", TimestampNTZType()),
    ("remote_ip", StringType()),
    ("remote_user", StringType()),
    ("method", StringType()),
    ("url", StringType()),
    ("protocol", StringType()),
    ("status", IntegerType()),
    ("size", IntegerType()),
    ("referer", StringType()),
    ("user_agent", StringType()),
    ("year", IntegerType()),
    ("month", IntegerType()),
    ("day", IntegerType()),
    ("hour", IntegerType()),
)
ACCESS_LOGS_PARTITION = ("year", "month", "day")

# JSON values of a log stream. The watermark needs a zoned timestamp, so this one is
# ``timestamp`` rather than ``timestamp_ntz``.
STREAM_VALUE = _schema(
    ("timestamp", TimestampType()),
    ("level", StringType()),
    ("message", StringType()),
    ("logger", StringType()),
    ("thread", StringType()),
)

# Stream rows as stored: the event time as UTC ``timestamp_ntz``, like the batch tables.
STREAM_LOGS = StructType(
    [StructField("timestamp", TimestampNTZType(), True), *STREAM_VALUE.fields[1:], StructField("partition_date", DateType(), True)]
)

# Quarantined input: the raw text, which reader saw it, and why it was set aside.
QUARANTINE = _schema(("format", StringType()), ("value", StringType()), ("reason", StringType()))

# Quarantine rows stored next to the log table by the single-pass ingest, partitioned like it
# (by the ingestion day).
QUARANTINE_BY_DATE = StructType([*QUARANTINE.fields, StructField(LOGS_APP_PARTITION, DateType(), True)])
