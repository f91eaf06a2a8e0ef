"""Timestamp helpers. Stored timestamps are ``timestamp_ntz`` holding UTC wall-clock time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_wall_clock(instant: Column) -> Column:
    """A zoned ``timestamp`` (an instant) as ``timestamp_ntz`` in UTC, whatever the session zone.

    It goes by the microseconds since the epoch, not by local wall-clock time, which names two
    instants in the hour when a zone leaves daylight-saving time.
    """
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    none = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)


def ingest_time(ingest_ts: dt.datetime | str | None = None) -> Column:
    """The ingestion time as UTC ``timestamp_ntz``: a fixed value, or the query start time."""
    if ingest_ts is None:
        return utc_wall_clock(F.current_timestamp())
    if isinstance(ingest_ts, dt.datetime):
        if ingest_ts.tzinfo is not None:
            ingest_ts = ingest_ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
        ingest_ts = ingest_ts.isoformat(sep=" ")
    # Text, not a Python datetime literal: that would be read in the session time zone.
    return F.lit(ingest_ts).cast("timestamp_ntz")


def day_literal(as_of: dt.date | str | None) -> Column:
    """A date literal, or ``current_date()`` when none is given."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")
