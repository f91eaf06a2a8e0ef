"""Zone-less text times do not depend on the session time zone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions.access import access_time
from logloom.functions.normalize import iso_time, simple_time
from logloom.functions.timeutil import utc_wall_clock

TEXTS = ["2024-01-01 10:00:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "not a time"]
# 2024-03-10 02:30 does not exist in New York (clocks jump from 02:00 to 03:00) and
# 2024-11-03 01:30 happens twice there; as UTC text both are ordinary times.
AS_UTC = [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), None]


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def _parse(spark, **kw):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    return [r[0] for r in df.select(simple_time(F.col("t"), **kw).alias("ts")).collect()]


def test_utc_text_same_in_any_session_zone(spark, new_york):
    assert _parse(new_york) == AS_UTC


def test_text_in_a_named_zone(spark):
    got = _parse(spark, zone="Asia/Kolkata")
    assert got[0] == dt.datetime(2024, 1, 1, 4, 30) and got[3] is None


def test_session_zone_reading(spark, new_york):
    got = _parse(new_york, zone=None)
    assert got[0] == dt.datetime(2024, 1, 1, 15) and got[3] is None


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin"])
def test_every_hour_of_changeover_days(spark, zone):
    """Access, ISO and simple times, and instants, on both days when the session zone changes."""
    days = {"America/New_York": ("2024-03-10", "2024-11-03"), "Europe/Berlin": ("2024-03-31", "2024-10-27")}[zone]
    hours = [dt.datetime.fromisoformat(d) + dt.timedelta(minutes=30 * k) for d in days for k in range(-4, 56)]
    rows = [(h.strftime("%d/%b/%Y:%H:%M:%S +0000"), h.strftime("%Y-%m-%dT%H:%M:%S.000Z"), h.strftime("%Y-%m-%d %H:%M:%S"), int(h.replace(tzinfo=dt.timezone.utc).timestamp())) for h in hours]
    df = spark.createDataFrame(rows, "a string, i string, s string, e long")
    previous = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = df.select(
            access_time(F.col("a")).alias("a"), iso_time(F.col("i")).alias("i"), simple_time(F.col("s")).alias("s"),
            utc_wall_clock(F.timestamp_seconds("e")).alias("e"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)
    assert [tuple(r) for r in got] == [(h, h, h, h) for h in hours]
