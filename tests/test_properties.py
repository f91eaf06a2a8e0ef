"""Property tests: formatting then parsing an access line gives the fields back."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logloom.operators import parse as P

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
no_space = st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=12)
no_quote = st.text(st.characters(min_codepoint=32, max_codepoint=126, blacklist_characters='"'), max_size=15)
entry = st.fixed_dictionaries(
    {
        "ip": no_space,
        "when": st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2030, 12, 31)).map(lambda t: t.replace(microsecond=0)),
        "method": st.sampled_from(["GET", "POST", "PUT", "DELETE"]),
        "path": no_quote.map(lambda s: "/" + s),
        "status": st.integers(100, 599),
        "size": st.integers(0, 2**31 - 1),
        "referer": no_quote,
        "agent": no_quote,
    }
)


def _format(e):
    t = e["when"]
    stamp = f"{t.day:02d}/{MONTHS[t.month - 1]}/{t.year}:{t:%H:%M:%S} +0000"
    return (
        f'{e["ip"]} - - [{stamp}] "{e["method"]} {e["path"]} HTTP/1.1" {e["status"]} {e["size"]} '
        f'"{e["referer"]}" "{e["agent"]}"'
    )


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(entry, min_size=1, max_size=30))
def test_parse_of_format_is_identity(spark, entries):
    lines = spark.createDataFrame([(_format(e),) for e in entries], "value string")
    good, bad = P.parse_access_logs(lines, ingest_ts="2031-01-01 00:00:00")
    assert bad.count() == 0
    got = sorted(
        (r["ip_address"], r["timestamp"], r["http_method"], r["http_path"], r["http_status"], r["response_size"],
         r["referer"], r["user_agent"])
        for r in good.collect()
    )
    want = sorted(
        (e["ip"], e["when"], e["method"], e["path"], e["status"], e["size"],
         None if e["referer"] == "-" else e["referer"], None if e["agent"] == "-" else e["agent"])
        for e in entries
    )
    assert got == want


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(entry.map(_format), st.text(max_size=40)), min_size=1, max_size=30))
def test_good_plus_quarantine_equals_input(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = P.parse_access_logs(df, ingest_ts="2031-01-01 00:00:00")
    assert good.count() + bad.count() == len(lines)


LEVELS = ["INFO", "WARN", "ERROR", "DEBUG", "FATAL", None]
log_row = st.tuples(
    st.datetimes(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)),
    st.sampled_from(LEVELS),
    st.sampled_from(["a", "b", "c"]),
    st.sampled_from(["s1", "s2"]),
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(log_row, min_size=1, max_size=40))
def test_level_counts_never_exceed_totals(spark, rows):
    from logloom.operators import summaries as Q

    logs = spark.createDataFrame(rows, "timestamp timestamp_ntz, level string, logger string, source string")
    for r in Q.logger_activity_summary(logs).collect():
        assert r["error_count"] + r["warn_count"] + r["info_count"] <= r["total_logs"]
    for r in Q.source_activity_summary(logs).collect():
        assert r["error_count"] + r["warn_count"] + r["info_count"] + r["debug_count"] <= r["total_logs"]
    assert sum(r["count"] for r in Q.level_distribution(logs).collect()) == len(rows)
    assert Q.total_count(logs).collect()[0]["total_records"] == len(rows)


# Text built from the characters the single-pass capture uses as marks and separator, plus a few
# characters of the grammar.
marks = st.text(st.sampled_from(["\u0001", "\u0002", "\u0003", "a", "/", " ", "-", '"', "["]), max_size=12)
marked_entry = entry.flatmap(lambda e: marks.map(lambda m: {**e, "path": e["path"] + m.replace('"', "")}))
noisy_line = st.one_of(
    entry.map(_format),
    marked_entry.map(_format),
    st.tuples(marks, entry.map(_format)).map(lambda t: t[0] + t[1]),
    st.tuples(entry.map(_format), marks).map(lambda t: t[0] + t[1]),
    marks,
)


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(noisy_line, min_size=1, max_size=30))
def test_single_pass_capture_equals_group_by_group(spark, lines):
    """The one-regex capture equals a match test plus one regexp_extract per group, also for
    lines holding the mark and separator characters."""
    from pyspark.sql import functions as F

    from logloom.functions import access as A

    df = spark.createDataFrame([(x,) for x in lines], "value string")
    head = A.anchored(A.ACCESS_LINE_PATTERN)
    got = A.capture_groups(df, "value", A.ACCESS_LINE_PATTERN, A.ACCESS_GROUPS).select(
        "m",
        F.when(F.col("value").rlike(head), F.array(*[F.regexp_extract("value", head, i + 1) for i in range(8)])).alias("e"),
    )
    for r in got.collect():
        assert r["m"] == r["e"]
