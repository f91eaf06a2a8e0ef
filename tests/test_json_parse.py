"""JSON application logs: explicit schema, defaults, time handling, quarantine."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import parse as P
from logloom.sources import files

INGEST = "2025-09-01 12:00:00"


def _rec(ts, level, msg, logger="com.app.Svc", **extra):
    d = {"timestamp": ts, "level": level, "message": msg, "logger": logger, "thread": "main",
         "source_file": "Svc.java", "line_number": 10}
    d.update(extra)
    return {k: v for k, v in d.items() if v is not None}


ROWS = [
    _rec("2025-08-25T06:00:00.000Z", "INFO", "started"),
    _rec("2025-08-25T06:01:00.000Z", "WARN", "slow"),
    _rec("2025-08-25T06:02:00.000Z", "ERROR", "failed", exception_class="java.io.IOException", exception_message="disk"),
    _rec("2025-08-25T06:03:00.000Z", "FATAL", "down", exception_class="java.lang.OutOfMemoryError"),
    _rec("2025-08-25T06:04:00.000Z", "DEBUG", "detail"),
    _rec("yesterday", "INFO", "bad time"),
    _rec("2025-08-25T06:05:00.000Z", None, "no level"),
    _rec("2025-08-25T06:06:00+05:30", "INFO", "offset"),
    _rec(None, "INFO", "no time"),
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    lines = [json.dumps(r) for r in ROWS] + ["this is not json"]
    (d / "app_logs.json").write_text("\n".join(lines) + "\n")
    (d / "notes.txt").write_text("ignored\n")
    raw = files.read_json_logs(spark, str(d))
    good, bad = P.parse_json_logs(raw, ingest_ts=INGEST)
    return {r["message"]: r.asDict() for r in good.collect()}, bad.collect()


def test_counts(parsed):
    good, bad = parsed
    assert len(good) == len(ROWS) and len(bad) == 1
    assert bad[0]["value"] == "this is not json" and bad[0]["reason"] == P.CORRUPT_JSON and bad[0]["format"] == "json"


def test_absent_http_fields_are_null_or_zero(parsed):
    r = parsed[0]["started"]
    assert r["ip_address"] is None and r["http_method"] is None and r["user_agent"] is None
    assert r["http_status"] == 0 and r["response_size"] == 0


def test_milliseconds_and_z_are_utc(parsed):
    assert parsed[0]["started"]["timestamp"] == dt.datetime(2025, 8, 25, 6, 0, 0)
    assert parsed[0]["started"]["partition_date"] == dt.date(2025, 8, 25)


def test_offset(parsed):
    assert parsed[0]["offset"]["timestamp"] == dt.datetime(2025, 8, 25, 0, 36, 0)


def test_bad_time_kept_with_ingest_date(parsed):
    r = parsed[0]["bad time"]
    assert r["timestamp"] is None and r["partition_date"] == dt.date(2025, 9, 1)


def test_missing_time_is_ingest_time(parsed):
    r = parsed[0]["no time"]
    assert r["timestamp"] == dt.datetime(2025, 9, 1, 12) and r["ingestion_timestamp"] == dt.datetime(2025, 9, 1, 12)


def test_defaults(parsed):
    assert parsed[0]["no level"]["level"] == "INFO"
    r = parsed[0]["down"]
    assert r["exception_class"] == "java.lang.OutOfMemoryError" and r["exception_message"] is None


def test_from_json_matches_file_reader(spark, parsed):
    values = spark.createDataFrame([(json.dumps(r),) for r in ROWS] + [("this is not json",)], "value string")
    good, bad = P.parse_json_logs(P.parse_json_values(values), ingest_ts=INGEST)
    assert {r["message"]: r.asDict() for r in good.collect()} == parsed[0]
    assert bad.count() == 1


def test_mistyped_fields_keep_the_line(spark):
    lines = [
        '{"message": "a", "http_status": "404", "line_number": "12"}',
        '{"message": "b", "line_number": 99999999999, "response_size": 12.5}',
        '{"message": "c", "line_number": "abc", "level": 7, "logger": {"x": 1}}',
        '{"message": "d", "timestamp": 5}',
    ]
    good, bad = P.parse_json_logs(P.parse_json_values(spark.createDataFrame([(x,) for x in lines], "value string")), ingest_ts=INGEST)
    got = {r.message: (r.http_status, r.line_number, r.response_size, r.level, r.logger) for r in good.collect()}
    assert bad.count() == 0
    assert got == {
        "a": (404, 12, 0, "INFO", "unknown"),
        "b": (0, 0, 12, "INFO", "unknown"),
        "c": (0, 0, 0, "7", '{"x":1}'),
        "d": (0, 0, 0, "INFO", "unknown"),
    }


def test_blank_lines_are_no_records(spark):
    lines = ["", "   ", "\t", None, '{"message": "a"}', "null", "[]", '[{"message": "b"}]', "7", '"x"', '{"message": "cut']
    good, bad = P.parse_json_logs(P.parse_json_values(spark.createDataFrame([(x,) for x in lines], "value string")), ingest_ts=INGEST)
    assert [r.message for r in good.collect()] == ["a"]
    assert sorted(r.value for r in bad.collect()) == sorted(lines[5:])


def test_read_logs_union_and_prefer(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        '1.2.3.4 - - [25/Aug/2025:06:04:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"\nnot an access line\n'
    )
    (tmp_path / "b.json").write_text(json.dumps(ROWS[0]) + "\n")
    good, bad = files.read_logs(spark, str(tmp_path), ingest_ts=INGEST)
    assert good.count() == 2 and bad.count() == 1
    good, _ = files.read_logs(spark, str(tmp_path), prefer="apache", ingest_ts=INGEST)
    assert [r["logger"] for r in good.collect()] == ["apache.access"]


def test_read_logs_without_input_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_logs(spark, str(tmp_path))


def test_spread_scan_only_when_asked(spark, tmp_path):
    (tmp_path / "one.log").write_text("a\nb\n")
    scan = spark.read.text(str(tmp_path / "one.log"))
    assert files.spread_scan(scan) is scan and files.spread_scan(scan, 0) is scan
    spread = files.spread_scan(scan, min_partitions=8)
    assert spread.select(F.spark_partition_id()).distinct().count() <= 8 and sorted(r[0] for r in spread.collect()) == ["a", "b"]
    assert "Exchange" not in files.read_access_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
