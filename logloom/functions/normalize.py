"""Normalisation of parsed records into the curated log tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeutil import ingest_time, utc_wall_clock

# ---------------------------------------------------------------------------------------------
# Defaults written into absent fields of a parsed record, and the hour-bucket
# and label texts of the summary tables.
FIELD_DEFAULTS = {
    "level": "INFO",
    "message": "",
    "logger": "unknown",
    "thread": "main",
    "source_file": "",
    "line_number": 0,
    "http_status": 0,
    "response_size": 0,
}
HOUR_BUCKET_FORMAT = "yyyy-MM-dd HH:00:00"
NO_EXCEPTION_LABEL = "No Exception"
NO_MESSAGE_LABEL = "No Message"
SIMPLE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------------------------


# A date, or a date and time, with nothing behind it: no zone is named.
ZONELESS = r"^\s*[+-]?[0-9]{4,6}(-[0-9]{1,2}){0,2}([T ][0-9:.]*)?\s*$"


def iso_time(text: Column, zone: str | None = "UTC") -> Column:
    """ISO-8601 text (milliseconds, ``Z``, a numeric offset or a zone name) to UTC ``timestamp_ntz``; NULL
    when unparsable. Text that names no zone is wall-clock time in ``zone`` (default UTC), whatever the
    session time zone; ``zone=None`` reads it in the session time zone."""
    instant = utc_wall_clock(text.try_cast("timestamp"))
    if zone is None:
        return instant
    wall = text.try_cast("timestamp_ntz")
    if zone != "UTC":
        wall = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.when(F.rlike(text, F.lit(ZONELESS)), wall).otherwise(instant)


def iso_instant(text: Column, zone: str | None = "UTC") -> Column:
    """``iso_time`` as a zoned ``timestamp`` (which a watermark needs)."""
    return F.concat(iso_time(text, zone).cast("string"), F.lit("+00:00")).cast("timestamp")


def record_time(text: Column, ingest_ts: Column) -> Column:
    """Event time of a record: an absent time becomes the ingest time; a bad one stays NULL."""
    return F.when(text.isNull(), ingest_ts).otherwise(iso_time(text))


def simple_time(text: Column, fmt: str = SIMPLE_TIME_FORMAT, zone: str | None = "UTC") -> Column:
    """Zone-less time text (``fmt``, default ``yyyy-MM-dd HH:mm:ss``) to UTC ``timestamp_ntz``;
    NULL when unparsable.

    The text is the wall-clock time in ``zone`` (default UTC), whatever the session time zone:
    it is parsed with an explicit ``+0000`` offset, which is exact on every date (no daylight-
    saving gap of the session zone can move it), then moved from ``zone`` to UTC.
    ``zone=None`` reads the text in the session time zone instead, as ``to_timestamp`` does.
    ``fmt`` must not contain a zone or offset field itself.
    """
    if zone is None:
        return utc_wall_clock(F.try_to_timestamp(text, F.lit(fmt)))
    wall = utc_wall_clock(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(fmt + " Z")))
    return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def with_default(column: str) -> Column:
    """An absent field replaced by its default (no default: stays NULL)."""
    if column in FIELD_DEFAULTS:
        return F.coalesce(F.col(column), F.lit(FIELD_DEFAULTS[column]))
    return F.col(column)


def day_of(ts: Column, ingest_ts: Column) -> Column:
    """Partition date: the day of the event, or of the ingestion when the time is unknown."""
    return F.to_date(F.coalesce(ts, ingest_ts))


def hour_bucket(ts: Column) -> Column:
    """Hour bucket as text, ``yyyy-MM-dd HH:00:00``."""
    return F.date_format(ts, HOUR_BUCKET_FORMAT)


def calendar_columns(ts: Column) -> list[Column]:
    """year, month, day and hour of a timestamp, as ints."""
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
    ]


def stamp_batch(rows: DataFrame, batch_id: str, ingest_ts: dt.datetime | str | None = None) -> DataFrame:
    """Rows with the batch they came in: ``ingested_at`` (UTC) and ``batch_id``."""
    return rows.withColumns({"ingested_at": ingest_time(ingest_ts), "batch_id": F.lit(batch_id)})


def exception_label(column: Column) -> Column:
    return F.coalesce(column, F.lit(NO_EXCEPTION_LABEL))


def message_label(column: Column) -> Column:
    return F.coalesce(column, F.lit(NO_MESSAGE_LABEL))
