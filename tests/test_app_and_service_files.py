"""End to end on JSON files of the application-log and service-log shape (15 rows each:
application INFO 7, WARN 3, ERROR 3, DEBUG 1, FATAL 1; service INFO 7, WARN 3, ERROR 3, DEBUG 2),
written here with new content."""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest

from logloom.operators import summaries as Q
from logloom.plans import pipelines as J

APP_LEVELS = ["INFO"] * 7 + ["WARN"] * 3 + ["ERROR"] * 3 + ["DEBUG"] + ["FATAL"]
SERVICE_LEVELS = ["INFO"] * 7 + ["WARN"] * 3 + ["ERROR"] * 3 + ["DEBUG"] * 2


def _lines(levels, hour, logger_prefix):
    out = []
    for i, level in enumerate(levels):
        rec = {
            "timestamp": f"2025-08-25T{hour:02d}:{i:02d}:00.000Z",
            "level": level,
            "message": f"event {i % 4}",
            "logger": f"{logger_prefix}.{['Api', 'Db', 'Cache'][i % 3]}",
            "thread": "main",
            "source_file": "Main.java",
            "line_number": 10 + i,
        }
        if level in ("ERROR", "FATAL"):
            rec["exception_class"] = f"Ex{i % 2}"
            if i % 2:
                rec["exception_message"] = "failure"
        out.append(json.dumps(rec))
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("mock")
    (raw / "application.json").write_text("\n".join(_lines(APP_LEVELS, 6, "com.shop")) + "\n")
    (raw / "service.json").write_text("\n".join(_lines(SERVICE_LEVELS, 7, "com.svc")) + "\n")
    name = f"mock_{uuid.uuid4().hex[:8]}.logs"
    res = J.ingest_logs(spark, str(raw), name, ingest_ts="2025-08-26 00:00:00", quarantine_table=name + "_rejects")
    assert (res.rows_written, res.rows_quarantined) == (30, 0)
    return spark.table(name)


def test_level_distribution(table):
    got = {r["level"]: r["count"] for r in Q.level_distribution(table).collect()}
    assert got == {"INFO": 14, "WARN": 6, "ERROR": 6, "DEBUG": 3, "FATAL": 1}


def test_time_span_and_partition(table):
    r = table.agg({"timestamp": "min"}).collect()[0][0], table.agg({"timestamp": "max"}).collect()[0][0]
    assert r == (dt.datetime(2025, 8, 25, 6, 0), dt.datetime(2025, 8, 25, 7, 14))
    assert [x["partition_date"] for x in table.select("partition_date").distinct().collect()] == [dt.date(2025, 8, 25)]


def test_summaries(table):
    top = Q.top_errors_by_logger(table).collect()
    assert sum(r["error_count"] for r in top) == 12  # ERROR + WARN, FATAL excluded
    hourly = {(r["hour"], r["level"]): r["error_count"] for r in Q.hourly_error_trends_loggers(table).collect()}
    assert hourly[("2025-08-25 06:00:00", "FATAL")] == 1 and ("2025-08-25 07:00:00", "FATAL") not in hourly
    exc = Q.exception_summary(table).collect()
    assert sum(r["occurrence_count"] for r in exc) == 6
    assert {r["exception_type"] for r in exc} <= {"failure", "No Message"}
    activity = Q.logger_activity_summary(table).collect()
    assert sum(r["total_logs"] for r in activity) == 30
    assert all(r["http_status"] == 0 and r["ip_address"] is None for r in table.collect())
