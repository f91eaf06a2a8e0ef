"""Access-line parsing: the cases of the combined-format grammar, and quarantine."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions import access as A
from logloom.operators import parse as P

INGEST = "2025-09-01 00:00:00"
OK = '192.168.1.100 - - [25/Aug/2025:06:04:00 +0000] "GET /api/users HTTP/1.1" 200 1234 "-" "Mozilla/5.0"'

CASES = {
    "ok_200": (OK, None),
    "status_404": ('10.0.0.1 - - [25/Aug/2025:06:05:00 +0000] "POST /login HTTP/1.1" 404 10 "http://r" "ua"', None),
    "status_500": ('10.0.0.1 - - [25/Aug/2025:06:06:00 +0000] "GET /x HTTP/2.0" 500 0 "" ""', None),
    "size_dash": ('10.0.0.1 - - [25/Aug/2025:06:07:00 +0000] "GET /x HTTP/1.1" 200 - "-" "-"', P.NO_MATCH),
    "named_user": ('10.0.0.1 - bob [25/Aug/2025:06:08:00 +0000] "GET /x HTTP/1.1" 200 5 "-" "-"', P.NO_MATCH),
    "path_space": ('10.0.0.1 - - [25/Aug/2025:06:09:00 +0000] "GET /a b HTTP/1.1" 200 5 "-" "-"', None),
    "offset_0530": ('10.0.0.1 - - [25/Aug/2025:06:10:00 +0530] "GET /x HTTP/1.1" 200 5 "-" "-"', None),
    "impossible_date": ('10.0.0.1 - - [32/Aug/2025:06:11:00 +0000] "GET /x HTTP/1.1" 200 5 "-" "-"', P.BAD_TIMESTAMP),
    "trailing_text": (OK + " extra fields here", None),
    "leading_text": ("junk " + OK, P.NO_MATCH),
    "empty_line": ("", P.NO_MATCH),
    "huge_status": ('10.0.0.1 - - [25/Aug/2025:06:12:00 +0000] "GET /x HTTP/1.1" 99999999999 5 "-" "-"', P.NUMBER_OUT_OF_RANGE),
    "separator_in_path": ('10.0.0.1 - - [25/Aug/2025:06:13:00 +0000] "GET /a\u0001b HTTP/1.1" 200 7 "-" "-"', None),
    "marks_in_path": ('10.0.0.1 - - [25/Aug/2025:06:14:00 +0000] "GET /\u0003a\u0002 HTTP/1.1" 200 7 "-" "\u0003"', None),
    # the marks are non-space characters, so here they belong to the address (a match)
    "match_mark_first": ("\u0003" + OK, None),
    "line_mark_first": ("\u0002" + OK, None),
    "only_a_mark": ("\u0003", P.NO_MATCH),
    "mark_then_junk": ("\u0003 junk", P.NO_MATCH),
}


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(k, v) for k, (v, _) in CASES.items()], "case string, value string")
    recs = P.access_records(lines.select("value", "case"), column="value")
    # access_records keeps only its own columns; join the case name back through the raw text
    rows = {r["_raw"]: r.asDict() for r in recs.collect()}
    return {k: rows[v] for k, (v, _) in CASES.items()}


@pytest.mark.parametrize("case", list(CASES))
def test_reason(parsed, case):
    assert parsed[case]["_reason"] == CASES[case][1]


def test_fields_of_good_line(parsed):
    r = parsed["ok_200"]
    assert r["timestamp"] == dt.datetime(2025, 8, 25, 6, 4, 0)
    assert (r["level"], r["message"], r["logger"], r["thread"], r["source_file"]) == (
        "INFO", "GET /api/users - 200", "apache.access", "http-worker", "access.log",
    )
    assert (r["ip_address"], r["http_method"], r["http_path"], r["http_status"], r["response_size"]) == (
        "192.168.1.100", "GET", "/api/users", 200, 1234,
    )
    assert r["referer"] is None and r["user_agent"] == "Mozilla/5.0"
    assert r["exception_class"] is None and r["exception_message"] is None


def test_levels_and_http_errors(parsed):
    assert parsed["status_404"]["level"] == "WARN"
    assert parsed["status_404"]["exception_class"] == "HttpError"
    assert parsed["status_404"]["exception_message"] == "HTTP 404"
    assert parsed["status_500"]["level"] == "ERROR"
    # empty referer/agent stay empty strings; only "-" means absent
    assert parsed["status_500"]["referer"] == "" and parsed["status_500"]["user_agent"] == ""


def test_offset_is_converted_to_utc(parsed):
    assert parsed["offset_0530"]["timestamp"] == dt.datetime(2025, 8, 25, 0, 40, 0)


def test_path_with_space_and_separator(parsed):
    assert parsed["path_space"]["http_path"] == "/a b"
    assert parsed["separator_in_path"]["http_path"] == "/a\u0001b"
    assert parsed["separator_in_path"]["response_size"] == 7


def test_dash_size_option(spark):
    line = '10.0.0.1 - - [25/Aug/2025:06:07:00 +0000] "GET /x HTTP/1.1" 200 - "-" "-"'
    df = spark.createDataFrame([(line,)], "value string")
    good, bad = P.parse_access_logs(df, allow_dash_size=True, ingest_ts=INGEST)
    row = good.collect()[0]
    assert row["response_size"] == 0 and row["line_number"] == 0 and bad.count() == 0


def test_good_plus_quarantine_is_input(spark):
    lines = spark.createDataFrame([(v,) for v, _ in CASES.values()], "value string")
    good, bad = P.parse_access_logs(lines, ingest_ts=INGEST)
    assert good.count() + bad.count() == len(CASES)
    assert sorted(r["reason"] for r in bad.collect()) == sorted(r for _, r in CASES.values() if r)
    assert set(good.columns) == {f.name for f in __import__("logloom.schemas").schemas.LOGS_APP.fields}


def test_normalised_columns(spark):
    good, _ = P.parse_access_logs(spark.createDataFrame([(OK,)], "value string"), ingest_ts=INGEST)
    r = good.collect()[0]
    assert r["ingestion_timestamp"] == dt.datetime(2025, 9, 1)
    assert r["partition_date"] == dt.date(2025, 8, 25)
    assert r["line_number"] == 0


def test_single_pass_equals_group_by_group_extraction(spark):
    """The one-regex extraction gives exactly what one regexp_extract per group gives."""
    lines = spark.createDataFrame([(v,) for v, _ in CASES.values()], "value string")
    head = A.anchored(A.ACCESS_LINE_PATTERN)
    fast = A.capture_groups(lines, "value", A.ACCESS_LINE_PATTERN, A.ACCESS_GROUPS)
    slow = fast.select(
        "value",
        "m",
        F.when(F.col("value").rlike(head), F.array(*[F.regexp_extract("value", head, i + 1) for i in range(8)])).alias("e"),
    )
    for r in slow.collect():
        assert r["m"] == r["e"]


def test_access_table_shape(spark):
    lines = spark.createDataFrame(
        [('10.0.0.1 - bob [25/Aug/2025:16:07:00 +0000] "GET /x HTTP/1.0" 301 - "-" "curl"',), ("bad",)], "value string"
    )
    good, bad = P.access_table(lines)
    r = good.collect()[0]
    assert (r["remote_user"], r["protocol"], r["status"], r["size"]) == ("bob", "HTTP/1.0", 301, 0)
    assert (r["year"], r["month"], r["day"], r["hour"]) == (2025, 8, 25, 16)
    assert [x["reason"] for x in bad.collect()] == [P.NO_MATCH]


def test_parse_runs_regex_once_per_line(spark):
    """One regex rewrite per line (no separate match test), and the good/bad split must not
    copy the parse into a pushed-down filter."""
    lines = spark.createDataFrame([(OK,)], "value string")
    good, bad = P.parse_access_logs(lines, ingest_ts=INGEST)
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == 0 and plan.count("regexp_replace") == 1
