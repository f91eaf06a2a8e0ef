"""Log input derived from an ``events`` table (event_id, ts, user_id, event_type, value, props).

There is no log table among the test tables, so the log tables, raw access lines and raw JSON
lines are derived from ``events`` by fixed rules. Each derivation is one narrow projection, so
it runs where the ``events`` partitions are, with the columns pruned to those used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.files import spread_scan

# ---------------------------------------------------------------------------------------------
# The derivation rules of the test logs.
#   k                  number in props, '"k": ([0-9]+)'
#   level              error -> FATAL when event_id % 10 = 0, else ERROR; signup -> WARN;
#                      view -> DEBUG; anything else -> INFO
#   message            event_type || ' k=' || k
#   logger             'svc.' || event_type || '.' || user_id % 7
#   source             'svc-' || user_id % 7
#   exception_class    error and event_id % 3 <> 0: 'Err' || k % 5
#   exception_message  error and event_id % 3 = 1: 'code ' || k % 4
#   user_id            NULL when event_id % 20 = 0, else 'user_' || user_id
#   session_id         user_id || '-' || date
#   ip_address         NULL when event_id % 25 = 0, else '10.0.' || user_id % 16 || '.' || user_id % 251
# Access lines:
#   '10.0.0.' || user_id % 251 || ' - - [' || dd/MMM/yyyy:HH:mm:ss || ' +0000] "' || method || ' /'
#   || event_type || '/' || k || ' HTTP/1.1" ' || status || ' ' || size || ' "-" "ua/' || k || '"'
#   method POST for signup and purchase, else GET; status 500 for an error with even event_id,
#   404 for other errors, else 200; size k * 17, or '-' when event_id % 30 = 1.
# Every 50th line of either kind is odd, by event_id % 50:
#   access lines   0: 'garbage line'; 3: the time '32/Jan/2024:10:00:00 +0000'; 9: the size
#                  99999999999; 21: the time written with offset +0530
#   JSON lines     0: 'garbage line'; 7: the time written with offset +05:30; 11: no time; 13: a
#                  null time; 17: the time 'yesterday'; 19: line_number as text; 23: line_number
#                  99999999999; 29: line_number with .5; 31: the time without its Z; 37: three spaces; 41: 'null'; 43: an array
K_PATTERN = '"k": ([0-9]+)'
GARBAGE_LINE = "garbage line"
JSON_ARRAY_LINE = '[{"level": "ERROR"}]'
ACCESS_LINE_TIME = "dd/MMM/yyyy:HH:mm:ss"
# ---------------------------------------------------------------------------------------------


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, min_partitions: int | None = None) -> DataFrame:
    """The ``events`` table, read with its declared schema (no schema-inference job)."""
    scan = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return spread_scan(scan, min_partitions)


# The derivations as Spark SQL expressions (one ``selectExpr`` each: the rules read as stated
# above, and a query plan is built with a handful of calls instead of hundreds).
_K = f"regexp_extract(props, '{K_PATTERN}', 1)"
_K_INT = f"try_cast({_K} AS INT)"
_DAY = "CAST(ts AS DATE)"
LOG_EXPRESSIONS = {
    "timestamp": "ts",
    "partition_date": _DAY,
    "date_partition": _DAY,
    "level": "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'"
    " WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END",
    "message": f"event_type || ' k=' || {_K}",
    "logger": "'svc.' || event_type || '.' || CAST(user_id % 7 AS STRING)",
    "source": "'svc-' || CAST(user_id % 7 AS STRING)",
    "exception_class": f"CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'Err' || CAST({_K_INT} % 5 AS STRING) END",
    "exception_message": f"CASE WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'code ' || CAST({_K_INT} % 4 AS STRING) END",
    "user_id": "CASE WHEN event_id % 20 <> 0 THEN 'user_' || CAST(user_id AS STRING) END",
    "session_id": f"CAST(user_id AS STRING) || '-' || CAST({_DAY} AS STRING)",
    "ip_address": "CASE WHEN event_id % 25 <> 0"
    " THEN '10.0.' || CAST(user_id % 16 AS STRING) || '.' || CAST(user_id % 251 AS STRING) END",
}
ACCESS_LINE_EXPRESSION = (
    f"CASE WHEN event_id % 50 = 0 THEN '{GARBAGE_LINE}' ELSE"
    " '10.0.0.' || CAST(user_id % 251 AS STRING) || ' - - [' || CASE event_id % 50 WHEN 3 THEN '32/Jan/2024:10:00:00 +0000'"
    f" WHEN 21 THEN date_format(ts + INTERVAL 330 MINUTES, '{ACCESS_LINE_TIME}') || ' +0530'"
    f" ELSE date_format(ts, '{ACCESS_LINE_TIME}') || ' +0000' END"
    " || '] \"' || CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END"
    f" || ' /' || event_type || '/' || {_K} || ' HTTP/1.1\" '"
    " || CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '500' WHEN event_type = 'error' THEN '404' ELSE '200' END"
    " || ' ' || CASE WHEN event_id % 50 = 9 THEN '99999999999' WHEN event_id % 30 = 1 THEN '-'"
    f" ELSE CAST({_K_INT} * 17 AS STRING) END"
    f" || ' \"-\" \"ua/' || {_K} || '\"' END"
)


def event_logs(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One log row per event, carrying the columns of both curated log shapes.

    Columns: timestamp, partition_date, date_partition, level, message, logger, source,
    exception_class, exception_message, user_id, session_id, ip_address, then the ``keep``
    columns of ``events`` as they are.
    """
    return events.selectExpr(*[f"{sql} AS `{name}`" for name, sql in LOG_EXPRESSIONS.items()], *keep)


def event_access_lines(events: DataFrame) -> DataFrame:
    """One raw combined-format access line per event (``value`` column)."""
    return events.selectExpr(f"{ACCESS_LINE_EXPRESSION} AS value")


def event_app_records(events: DataFrame) -> DataFrame:
    """Application-log records (the JSON-line fields) derived from events, plus ``event_id``.

    ``timestamp`` is ISO-8601 text with milliseconds and ``Z``; thread is ``'worker-' ||
    source``, source_file ``source || '.py'``, line_number the length of the message.
    """
    logs = event_logs(events.withColumn("_eid", F.col("event_id")), keep=("_eid",))
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return logs.select(
        F.col("_eid").alias("event_id"),
        iso.alias("timestamp"),
        "level",
        "message",
        "logger",
        F.concat(F.lit("worker-"), F.col("source")).alias("thread"),
        F.concat(F.col("source"), F.lit(".py")).alias("source_file"),
        F.length("message").alias("line_number"),
        "exception_class",
        "exception_message",
    )


def event_json_lines(events: DataFrame) -> DataFrame:
    """One JSON text line per event (``value``), as an application would write it: absent
    fields are left out of the object, and some lines are odd (see the fixed values above)."""
    recs = event_app_records(events)
    fields = [c for c in recs.columns if c not in ("event_id", "timestamp")]
    odd = F.col("event_id") % 50
    shifted = F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) + F.expr("INTERVAL 330 MINUTES")
    time = (
        F.when(odd == 7, F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSS'+05:30'"))
        .when(odd == 17, F.lit("yesterday"))
        .when(odd == 31, F.rtrim(F.col("timestamp"), F.lit("Z")))
        .when(~odd.isin(11, 13), F.col("timestamp"))
    )
    json = F.to_json(F.struct(time.alias("timestamp"), *fields))
    json = F.when(odd == 13, F.concat(F.lit('{"timestamp":null,'), F.substring(json, 2, 2**31 - 1))).otherwise(json)
    number = F.regexp_extract(json, '"line_number":([0-9]+)', 1)

    def with_number(text: Column) -> Column:
        return F.regexp_replace(json, F.lit('"line_number":[0-9]+'), F.concat(F.lit('"line_number":'), text))

    line = (
        F.when(odd == 0, F.lit(GARBAGE_LINE))
        .when(odd == 19, with_number(F.concat(F.lit('"'), number, F.lit('"'))))
        .when(odd == 23, with_number(F.lit("99999999999")))
        .when(odd == 29, with_number(F.concat(number, F.lit(".5"))))
        .when(odd == 37, F.lit("   "))
        .when(odd == 41, F.lit("null"))
        .when(odd == 43, F.lit(JSON_ARRAY_LINE))
        .otherwise(json)
    )
    return recs.select(line.alias("value"))


def event_simple_records(events: DataFrame) -> DataFrame:
    """Simple-log input rows: ``timestamp_str`` as ``yyyy-MM-dd HH:mm:ss`` text, level,
    service (the source), message and metadata (the ``props`` JSON text)."""
    logs = event_logs(events, keep=("props",))
    return logs.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp_str"),
        "level",
        F.col("source").alias("service"),
        "message",
        F.col("props").alias("metadata"),
    )
