"""Generated and literal rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from logloom import schemas
from logloom.functions.normalize import simple_time
from logloom.functions.timeutil import ingest_time

# The synthetic service logs: levels, and a vocabulary of this library's own (any other can be passed).
LEVELS = ["INFO", "WARN", "ERROR", "DEBUG"]
SOURCES = ["billing", "catalogue", "gateway", "mailer", "scheduler"]
MESSAGES = [
    "request served", "retry scheduled", "queue drained", "lease lost", "config reloaded", "upstream timed out",
    "index rebuilt", "token refused", "snapshot stored", "worker drained",
]
WINDOW_MINUTES = 1440  # timestamps fall in the 24 hours before `now`
USER_RANGE = (1000, 9999)
ADDRESS_PREFIX = "192.168."


def _draw(seed: int, salt: int, n: int) -> Column:
    """A deterministic value in [0, n) from (seed, row id, salt)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt)), F.lit(n))


def _pick(values: Sequence[str], seed: int, salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(seed, salt, len(values)) + 1).cast("int"))


def generate_service_logs(
    spark: SparkSession,
    num_records: int = 1000,
    *,
    seed: int = 0,
    now: dt.datetime | str | None = None,
    batch_id: str | None = None,
    partitions: int | None = None,
    sources: Sequence[str] = SOURCES,
    messages: Sequence[str] = MESSAGES,
) -> DataFrame:
    """``num_records`` synthetic service-log rows (``LOGS_SERVICE``), made by the executors, with
    sources and messages from the given vocabulary.

    Every column is a hash of (seed, row id), so the rows are the same on every run and on
    any number of partitions; nothing is built in the driver.
    """
    now_col = ingest_time(now)
    batch = batch_id or str(uuid.uuid4())
    ids = spark.range(0, num_records, 1, partitions) if partitions else spark.range(num_records)
    lo, hi = USER_RANGE
    session = F.md5(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit("session")))
    session_id = F.concat_ws(
        "-", session.substr(1, 8), session.substr(9, 4), session.substr(13, 4), session.substr(17, 4), session.substr(21, 12)
    )
    ts = now_col - F.make_dt_interval(F.lit(0), F.lit(0), _draw(seed, 1, WINDOW_MINUTES + 1).cast("int"))
    return ids.select(
        ts.alias("timestamp"),
        _pick(LEVELS, seed, 2).alias("level"),
        _pick(messages, seed, 3).alias("message"),
        _pick(sources, seed, 4).alias("source"),
        F.concat(F.lit("user_"), (_draw(seed, 5, hi - lo + 1) + lo).cast("string")).alias("user_id"),
        session_id.alias("session_id"),
        F.concat(
            F.lit(ADDRESS_PREFIX), (_draw(seed, 6, 255) + 1).cast("string"), F.lit("."), (_draw(seed, 7, 255) + 1).cast("string")
        ).alias("ip_address"),
        now_col.alias("ingested_at"),
        F.lit(batch).alias("batch_id"),
        F.to_date(ts).alias(schemas.LOGS_SERVICE_PARTITION),
    )


def rows_with_text_times(
    spark: SparkSession,
    rows: Iterable[Sequence],
    schema: StructType,
    time_columns: Sequence[str] = ("timestamp",),
    fmt: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """Literal rows whose time columns are given as text, parsed after creation.

    ``schema`` declares the time columns as ``timestamp_ntz``; the rows carry text, which is
    read with ``fmt`` (unparsable text becomes NULL).
    """
    text_schema = StructType(
        [StructField(f.name, StringType(), True) if f.name in time_columns else f for f in schema.fields]
    )
    df = spark.createDataFrame(list(rows), text_schema)
    return df.select(
        *[
            simple_time(F.col(f.name), fmt).cast(TimestampNTZType()).alias(f.name) if f.name in time_columns else F.col(f.name)
            for f in schema.fields
        ]
    )
