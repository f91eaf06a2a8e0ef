"""Summary queries on small literal log tables."""

from __future__ import annotations

import datetime as dt

import pytest

from logloom.operators import summaries as Q

T0 = dt.datetime(2024, 1, 30, 10, 0, 0)
SCHEMA = (
    "timestamp timestamp_ntz, level string, message string, logger string, source string, "
    "exception_class string, exception_message string, user_id string, session_id string, "
    "ip_address string, partition_date date, date_partition date, http_method string, "
    "http_path string, http_status int, response_size int"
)


def _row(minutes, level, message="m", logger="a", source="s1", exc=None, exc_msg=None, user="u1", session="x",
         ip="1.1.1.1", method=None, path=None, status=0, size=0, day=None):
    ts = T0 + dt.timedelta(minutes=minutes)
    d = day or ts.date()
    return (ts, level, message, logger, source, exc, exc_msg, user, session, ip, d, d, method, path, status, size)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        _row(0, "ERROR", "boom", "a", exc="E1", exc_msg="code 1"),
        _row(1, "ERROR", "boom", "a", exc="E1", exc_msg="code 1"),
        _row(2, "ERROR", "boom", "b", exc="No Exception", exc_msg=None),
        _row(3, "ERROR", "zap", "b", exc=None, exc_msg=None),
        _row(4, "WARN", "slow", "b", user=None, ip=None),
        _row(5, "WARN", "slow", "c"),
        _row(6, "FATAL", "dead", "c"),
        _row(7, "INFO", "ok", "a", user="u2", session="y", ip="2.2.2.2", method="GET", path="/p", status=200, size=10),
        _row(8, "INFO", "ok", "a", method="GET", path="/p", status=200, size=30),
        _row(9, "DEBUG", "dbg", "c", method="POST", path="/q", status=500, size=5),
        _row(-29 * 24 * 60, "INFO", "old", "d"),
        _row(10, None, "no level", "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_top_errors_ties_broken_by_keys(logs):
    out = [tuple(r) for r in Q.top_errors_by_logger(logs, limit=3).select("level", "logger", "message", "error_count").collect()]
    assert out == [("ERROR", "a", "boom", 2), ("ERROR", "b", "boom", 1), ("ERROR", "b", "zap", 1)]


def test_top_errors_by_source_levels(logs):
    out = Q.top_errors_by_source(logs, levels=("FATAL",)).collect()
    assert [(r["level"], r["source"], r["error_count"]) for r in out] == [("FATAL", "s1", 1)]


def test_daily_summaries(logs):
    d = {(r["partition_date"], r["level"]): (r["log_count"], r["unique_loggers"]) for r in Q.daily_summary_loggers(logs).collect()}
    assert d[(dt.date(2024, 1, 30), "ERROR")] == (4, 2)
    assert d[(dt.date(2024, 1, 30), None)] == (1, 1)
    rows = Q.daily_summary_sources_users(logs).collect()
    assert rows[0]["date_partition"] == dt.date(2024, 1, 30)  # newest first
    warn = [r for r in rows if r["level"] == "WARN"][0]
    assert (warn["log_count"], warn["unique_sources"], warn["unique_users"]) == (2, 1, 1)


def test_hourly_trends(logs):
    rows = Q.hourly_error_trends_loggers(logs).collect()
    assert {r["level"] for r in rows} == {"ERROR", "WARN", "FATAL"}
    assert all(r["hour"] == "2024-01-30 10:00:00" for r in rows)
    assert [r["level"] for r in rows] == sorted(r["level"] for r in rows)


def test_activity_level_columns(logs):
    a = {r["logger"]: r.asDict() for r in Q.logger_activity_summary(logs).collect()}
    assert (a["a"]["total_logs"], a["a"]["error_count"], a["a"]["info_count"]) == (4, 2, 2)
    assert "debug_count" not in a["a"]
    s = Q.source_activity_summary(logs).collect()[0]
    assert s["debug_count"] == 1 and s["total_logs"] == 12
    # FATAL and NULL levels are in the total but in no level column
    assert s["total_logs"] > s["error_count"] + s["warn_count"] + s["info_count"] + s["debug_count"]


def test_exception_summary_groups_raw_values(logs):
    rows = Q.exception_summary(logs).collect()
    got = [(r["exception_class"], r["exception_type"], r["occurrence_count"], r["affected_loggers"]) for r in rows]
    # a real "No Exception" class and a NULL class are separate groups with the same label
    assert got == [
        ("E1", "code 1", 2, ["a"]),
        ("No Exception", "No Message", 1, ["b"]),
        ("No Exception", "No Message", 1, ["b"]),
    ]


def test_user_and_ip(logs):
    users = {r["user_id"]: r.asDict() for r in Q.user_activity_summary(logs).collect()}
    assert None not in users and users["u2"]["total_activity"] == 1
    assert users["u1"]["unique_sessions"] == 1 and users["u1"]["error_count"] == 4
    ips = Q.ip_address_analysis(logs, limit=1).collect()
    assert len(ips) == 1 and ips[0]["ip_address"] == "1.1.1.1"


def test_error_summary_and_counts(logs):
    assert [tuple(r)[:3] for r in Q.error_summary(logs).collect()] == [("ERROR", "s1", 4), ("WARN", "s1", 2)]
    assert Q.total_count(logs).collect()[0]["total_records"] == 12
    dist = Q.level_distribution(logs).collect()
    assert dist[0]["level"] == "ERROR" and sum(r["count"] for r in dist) == 12
    assert sum(r["log_count"] for r in Q.daily_level_counts(logs).collect()) == 12


def test_latest_and_sample(logs):
    assert Q.latest_rows(logs, n=1).collect()[0]["message"] == "no level"
    assert Q.sample_rows(logs, n=3).count() == 3
    first = Q.sample_rows(logs, n=1, order_by=["timestamp", "message"]).collect()[0]
    assert first["message"] == "old"


def test_recent_queries(logs):
    rows = Q.level_overview_recent(logs, as_of="2024-01-30").collect()
    assert "old" not in [r["level"] for r in rows] and sum(r["log_count"] for r in rows) == 11
    top = Q.top_error_loggers_recent(logs, as_of="2024-01-30").collect()
    assert [(r["logger"], r["error_count"], r["unique_exceptions"]) for r in top] == [("a", 2, 1), ("b", 2, 1)]
    assert Q.top_error_loggers_recent(logs, as_of="2024-03-30").count() == 0


def test_http(logs):
    rows = Q.http_traffic(logs, as_of="2024-01-30").collect()
    assert [(r["http_status"], r["http_method"], r["request_count"], r["avg_response_size"]) for r in rows] == [
        (200, "GET", 2, 20.0), (500, "POST", 1, 5.0)
    ]
    assert [tuple(r) for r in Q.top_paths(logs).collect()] == [("/p", 2), ("/q", 1)]


def test_stamp_and_approximate(logs):
    out = Q.daily_summary_loggers(logs, approximate=True, stamp="2024-02-01 00:00:00")
    r = out.collect()[0]
    assert r["aggregation_timestamp"] == dt.datetime(2024, 2, 1) and r["unique_loggers"] >= 1


def test_top_n_is_take_ordered(logs):
    plan = Q.top_errors_by_logger(logs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_partition_pruning_and_pushdown(spark, tmp_path, logs):
    logs.write.partitionBy("partition_date").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = Q.top_error_loggers_recent(stored, as_of="2024-01-30")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan
    assert "PushedFilters: [IsNotNull(level), EqualTo(level,ERROR)]" in plan


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_rollup_summaries_equal_direct(spark, sf):
    """Q3, Q5 and Q7 built from the hourly rollup equal the direct queries, row for row and in order."""
    import os

    from logloom import contract

    if not os.path.exists(sf):
        pytest.skip("test tables not present")
    logs = contract.logs(spark, sf)
    rollup = Q.hourly_logger_rollup(logs)
    pairs = [
        (Q.daily_summary_loggers(logs), Q.daily_summary_loggers_from_rollup(rollup)),
        (Q.hourly_error_trends_loggers(logs), Q.hourly_error_trends_loggers_from_rollup(rollup)),
        (Q.logger_activity_summary(logs), Q.logger_activity_summary_from_rollup(rollup)),
    ]
    for direct, rolled in pairs:
        assert direct.schema == rolled.schema
        assert direct.collect() == rolled.collect()


def test_aggregation_shared_scan_equals_scan_per_table(spark, logs):
    """The application summary job gives the same tables with one shared rollup."""
    import uuid

    from logloom.plans import pipelines as J
    from logloom.plans import tables as T

    db = "t_" + uuid.uuid4().hex[:10]
    T.create_database(spark, db)
    T.append(logs, f"{db}.logs", partition_by=["partition_date"])
    direct = J.run_aggregation(spark, f"{db}.logs", f"{db}_a", kind="app")
    shared = J.run_aggregation(spark, f"{db}.logs", f"{db}_b", kind="app", shared_scan=True)
    assert direct.success and shared.success and sorted(direct.table_counts) == sorted(shared.table_counts)
    for name in Q.APP_SUMMARIES:
        a = spark.table(f"{db}_a.{name}").drop("aggregation_timestamp")
        b = spark.table(f"{db}_b.{name}").drop("aggregation_timestamp")
        assert a.schema == b.schema and sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
