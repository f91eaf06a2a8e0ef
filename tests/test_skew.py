"""A hot key holding a third of all rows: results stay exact (checked against pandas), and
the plans aggregate map-side before the shuffle."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.operators import summaries as Q

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    ids = spark.range(N, numPartitions=6)
    hot = F.col("id") % 3 == 0  # a third of the rows: one user, one level, one logger, one address
    df = ids.select(
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 5000).cast("int"))).cast(
            "timestamp_ntz"
        ).alias("timestamp"),
        F.when(hot, "ERROR").otherwise(F.element_at(F.array(F.lit("INFO"), F.lit("WARN"), F.lit("DEBUG")), (F.col("id") % 3 + 1).cast("int"))).alias("level"),
        F.when(hot, "hot.logger").otherwise(F.concat(F.lit("l"), (F.col("id") % 97).cast("string"))).alias("logger"),
        F.when(hot, "user_hot").otherwise(F.concat(F.lit("user_"), (F.col("id") % 1000).cast("string"))).alias("user_id"),
        F.concat(F.lit("s"), (F.col("id") % 4000).cast("string")).alias("session_id"),
        F.when(hot, "10.0.0.1").otherwise(F.concat(F.lit("10.1.0."), (F.col("id") % 200).cast("string"))).alias("ip_address"),
        F.concat(F.lit("m"), (F.col("id") % 7).cast("string")).alias("message"),
        F.lit("src").alias("source"),
        F.when(hot, "HotError").alias("exception_class"),
        F.when(hot & (F.col("id") % 2 == 0), "boom").alias("exception_message"),
    )
    return df, df.toPandas()


def test_user_activity_exact(skewed):
    df, pdf = skewed
    got = Q.user_activity_summary(df, limit=5).toPandas().set_index("user_id")
    g = pdf.groupby("user_id")
    want = pd.DataFrame(
        {
            "total_activity": g.size(),
            "unique_sessions": g["session_id"].nunique(),
            "unique_ip_addresses": g["ip_address"].nunique(),
            "error_count": g["level"].apply(lambda s: int((s == "ERROR").sum())),
        }
    ).sort_values(["total_activity"], ascending=False, kind="stable")
    want = want.sort_values(["total_activity"], ascending=[False]).loc[got.index]
    assert got.index[0] == "user_hot" and got.loc["user_hot", "total_activity"] == N // 3
    for col in want.columns:
        assert list(got[col]) == list(want[col])


def test_top_errors_and_exceptions_exact(skewed):
    df, pdf = skewed
    top = Q.top_errors_by_logger(df, limit=3).collect()
    errs = pdf[pdf.level.isin(["ERROR", "WARN"])].groupby(["level", "logger", "message"]).size()
    assert top[0]["error_count"] == errs.max()
    assert sum(r["count"] for r in Q.level_distribution(df).collect()) == N
    exc = {(r["exception_class"], r["exception_type"]): r for r in Q.exception_summary(df).collect()}
    want = pdf[pdf.level == "ERROR"].groupby(["exception_class", "exception_message"], dropna=False).size()
    assert exc[("HotError", "boom")]["occurrence_count"] == want[("HotError", "boom")]
    assert exc[("HotError", "boom")]["affected_loggers"] == ["hot.logger"]


def test_plans_aggregate_before_shuffle(skewed):
    df, _ = skewed
    for q in (Q.user_activity_summary(df), Q.top_errors_by_logger(df), Q.exception_summary(df)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        first_exchange = plan.rfind("Exchange")
        assert "partial_" in plan[first_exchange:], "no map-side partial aggregation below the first shuffle"


def test_rollup_forms_exact_under_a_hot_logger(skewed):
    """A logger with a third of all rows: the shared-scan forms equal the direct queries."""
    df, _ = skewed
    logs = df.withColumn("partition_date", F.to_date("timestamp"))
    rollup = Q.hourly_logger_rollup(logs)
    for direct, rolled in (
        (Q.daily_summary_loggers(logs), Q.daily_summary_loggers_from_rollup(rollup)),
        (Q.hourly_error_trends_loggers(logs), Q.hourly_error_trends_loggers_from_rollup(rollup)),
        (Q.logger_activity_summary(logs), Q.logger_activity_summary_from_rollup(rollup)),
    ):
        assert direct.collect() == rolled.collect()
    hot = {r["logger"]: r for r in Q.logger_activity_summary_from_rollup(rollup).collect()}["hot.logger"]
    assert hot["total_logs"] == N // 3 and hot["error_count"] == N // 3
