"""Tables, SQL scripts and jobs on the session catalog."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import summaries as Q
from logloom.plans import pipelines as J
from logloom.plans import script as S
from logloom.plans import tables as T
from logloom.sources.generate import generate_service_logs, rows_with_text_times

ACCESS = '10.0.0.{i} - - [25/Aug/2025:06:0{i}:00 +0000] "GET /p{i} HTTP/1.1" {status} 10 "-" "-"'


def _db():
    return "t_" + uuid.uuid4().hex[:10]


def test_split_statements():
    script = """
    -- comment; with a semicolon
    SELECT 'a;b' AS x;  /* block; comment */
    SELECT "q;" AS `c;d`;
    ;
    -- only a comment
    """
    parts = S.split_statements(script)
    assert len(parts) == 2
    assert parts[0].endswith("SELECT 'a;b' AS x")
    assert parts[1].startswith("/* block; comment */")


def test_run_statements_and_verdict(spark):
    results = S.run_statements(spark, "SELECT 1 AS a UNION ALL SELECT 2; SELECT * FROM no_such_table_x; CREATE TEMPORARY VIEW v_ok AS SELECT 1 AS a")
    assert [(r.statement_index, r.row_count, r.success) for r in results] == [(1, 2, True), (2, 0, False), (3, 0, True)]
    assert results[1].error and "no_such_table_x" in results[1].error
    assert S.script_passed(results)
    assert not S.script_passed(results, min_success_rate=0.9)
    assert S.script_passed([]) and not S.script_passed([], empty_ok=False)
    assert S.report_frame(spark, results).count() == 3
    long = S.run_statements(spark, "SELECT " + " + ".join(["1"] * 60) + " AS s")[0]
    assert len(long.statement) == 103 and long.statement.endswith("...")


def test_create_append_describe_count(spark):
    db = _db()
    T.create_database(spark, db)
    table = f"{db}.logs"
    T.create_table(spark, table, schemas.LOGS_APP, partition_by=["partition_date"], properties={"team": "tests"})
    T.create_table(spark, table, schemas.LOGS_APP, partition_by=["partition_date"])  # exists: no-op
    lines = spark.createDataFrame([(ACCESS.format(i=i, status=200 + 100 * (i % 4)),) for i in range(1, 8)], "value string")
    from logloom.operators.parse import parse_access_logs

    good, _ = parse_access_logs(lines, ingest_ts="2025-09-01 00:00:00")
    T.append(good, table, partition_by=["partition_date"])
    T.append(good, table, partition_by=["partition_date"])
    assert spark.table(table).count() == 14
    assert {r["col_name"] for r in T.describe_table(spark, table).collect()} >= {"timestamp", "partition_date"}
    assert table.split(".")[1] in [r["tableName"] for r in T.list_tables(spark, db).collect()]
    assert db in [r["namespace"] for r in T.list_databases(spark).collect()]
    T.replace_table(Q.level_distribution(spark.table(table)), f"{db}.levels")
    T.replace_table(Q.total_count(spark.table(table)), f"{db}.levels")  # replaced, not appended
    counts = {r["table_name"]: r["row_count"] for r in T.table_row_counts(spark, db).collect()}
    assert counts == {"levels": 1}
    counts = {r["table_name"]: r["row_count"] for r in T.table_row_counts(spark, db, exclude=()).collect()}
    assert counts == {"levels": 1, "logs": 14}


def test_recreate_table_and_overwrite_path(spark, tmp_path):
    db = _db()
    T.create_database(spark, db)
    table = f"{db}.access"
    T.recreate_table(spark, table, schemas.ACCESS_LOGS, partition_by=list(schemas.ACCESS_LOGS_PARTITION))
    T.recreate_table(spark, table, schemas.ACCESS_LOGS, partition_by=list(schemas.ACCESS_LOGS_PARTITION))
    assert spark.table(table).count() == 0
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["year", "month", "day"]
    path = str(tmp_path / "p")
    T.overwrite_path(spark.range(5), path)
    T.overwrite_path(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_build_tables_skip_keeps_existing(spark):
    db = _db()
    T.create_database(spark, db)
    logs = generate_service_logs(spark, 200, seed=3, now="2024-01-30 12:00:00", batch_id="b")
    written = T.build_tables(spark, logs, db, {"error_summary": Q.error_summary}, if_exists="skip")
    assert written == [f"{db}.error_summary"]
    assert T.build_tables(spark, logs, db, {"error_summary": Q.error_summary}, if_exists="skip") == []
    assert "created_at" in spark.table(f"{db}.error_summary").columns


def test_generator_is_deterministic_and_distributed(spark):
    a = generate_service_logs(spark, 500, seed=7, now="2024-01-30 12:00:00", batch_id="b", partitions=3)
    b = generate_service_logs(spark, 500, seed=7, now="2024-01-30 12:00:00", batch_id="b", partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    r = a.agg(F.min("timestamp"), F.max("timestamp"), F.countDistinct("level"), F.countDistinct("source")).collect()[0]
    assert r[0] >= dt.datetime(2024, 1, 29, 12) and r[1] <= dt.datetime(2024, 1, 30, 12)
    assert (r[2], r[3]) == (4, 5)
    assert a.schema.fieldNames() == schemas.LOGS_SERVICE.fieldNames()


def test_literal_rows_with_text_times(spark):
    df = rows_with_text_times(
        spark,
        [("2025-08-25 06:00:00", "INFO", "api", "ok", "{}", "2025-08-25 07:00:00"), ("nope", "WARN", "db", "x", None, None)],
        schemas.LOGS_SIMPLE,
        time_columns=("timestamp", "ingestion_time"),
    )
    rows = df.collect()
    assert rows[0]["timestamp"] == dt.datetime(2025, 8, 25, 6) and rows[1]["timestamp"] is None
    assert df.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"


def test_ingest_logs_job(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text("\n".join(ACCESS.format(i=i, status=200) for i in range(1, 4)) + "\nnot a line\n")
    (raw / "b.json").write_text('{"timestamp": "2025-08-25T06:00:00.000Z", "level": "ERROR", "message": "x"}\n{oops\n')
    db = _db()
    res = J.ingest_logs(spark, str(raw), f"{db}.logs", ingest_ts="2025-09-01 00:00:00", quarantine_table=f"{db}.rejects")
    assert (res.rows_written, res.rows_quarantined) == (4, 2)
    assert spark.table(f"{db}.logs").count() == 4 and spark.table(f"{db}.rejects").count() == 2
    res = J.ingest_logs(spark, str(raw), f"{db}.logs", ingest_ts="2025-09-01 00:00:00")
    assert res.rows_written == 4 and spark.table(f"{db}.logs").count() == 8


def test_service_ingest_and_aggregation(spark):
    db = _db()
    rep = J.ingest_service_logs(spark, f"{db}.logs", 300, seed=1, now="2024-01-30 12:00:00", batch_id="b1")
    assert rep.rows_written == 300 and rep.total_records == 300
    assert sum(n for _, n in rep.level_distribution) == 300
    assert J.verify_source(spark, f"{db}.logs") == (True, 300)
    assert J.verify_source(spark, f"{db}.nothing") == (False, 0)
    out = J.run_aggregation(spark, f"{db}.logs", db, kind="service")
    assert out.success and out.source_rows == 300
    assert {n for n, _ in out.table_counts} == set(Q.SERVICE_SUMMARIES)
    out = J.run_aggregation(spark, f"{db}.logs", db, script="SELECT 1; SELECT * FROM nope_x; SELECT * FROM nope_y")
    assert not out.success and len(out.statements) == 3
    assert not J.run_aggregation(spark, f"{db}.absent", db).success


def test_aggregation_on_empty_source_succeeds(spark):
    db = _db()
    T.create_database(spark, db)
    T.create_table(spark, f"{db}.logs", schemas.LOGS_SERVICE, partition_by=["date_partition"])
    out = J.run_aggregation(spark, f"{db}.logs", db)
    assert out.success and out.source_rows == 0 and out.tables_written == []


def test_table_report(spark):
    db = _db()
    J.ingest_service_logs(spark, f"{db}.logs", 50, seed=2, now="2024-01-30 12:00:00", batch_id="b")
    rep = J.table_report(spark, f"{db}.logs", n=5)
    assert rep["count"].collect()[0]["total_records"] == 50
    assert rep["sample"].count() == 5
    assert sum(r["count"] for r in rep["levels"].collect()) == 50
    assert rep["tables"].where("NOT isTemporary").count() == 1 and rep["schema"].count() >= 10


def test_overwrite_partitions_keeps_other_days(spark):
    db = _db()
    T.create_database(spark, db)
    rows = [(dt.date(2024, 1, d), "INFO", d) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "date_partition date, level string, log_count int")
    T.overwrite_partitions(df, f"{db}.s", partition_by=["date_partition"])
    T.overwrite_partitions(df.where("date_partition = date'2024-01-03'").selectExpr("date_partition", "level", "99 AS log_count"),
                           f"{db}.s", partition_by=["date_partition"])
    got = {r["date_partition"].day: r["log_count"] for r in spark.table(f"{db}.s").collect()}
    assert got == {1: 1, 2: 2, 3: 99}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_refresh_daily_summaries_equals_full_build(spark):
    db = _db()
    src = f"{db}.logs"
    early = generate_service_logs(spark, 400, seed=5, now="2024-01-10 12:00:00", batch_id="a")
    late = generate_service_logs(spark, 400, seed=6, now="2024-01-11 12:00:00", batch_id="b")
    T.create_database(spark, db)
    T.append(early, src, partition_by=["date_partition"])
    J.refresh_daily_summaries(spark, src, db, days=365, as_of="2024-01-11")
    T.append(late, src, partition_by=["date_partition"])
    J.refresh_daily_summaries(spark, src, db, days=1, as_of="2024-01-11")
    full = Q.daily_level_counts(spark.table(src))
    assert sorted(map(tuple, spark.table(f"{db}.daily_summary").select(*full.columns).collect())) == sorted(
        map(tuple, full.collect())
    )


def test_clean_input_needs_no_quarantine_pass(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text("\n".join(ACCESS.format(i=i, status=200) for i in range(1, 4)) + "\n")
    db = _db()
    sc = spark.sparkContext
    sc.setJobGroup("clean-ingest", "clean")
    res = J.ingest_logs(spark, str(raw), f"{db}.logs", ingest_ts="2025-09-01 00:00:00", quarantine_table=f"{db}.rejects")
    assert (res.rows_written, res.rows_quarantined) == (3, 0)
    assert not T.table_exists(spark, f"{db}.rejects")


def test_append_rebalance_and_sorted_layout(spark, tmp_path):
    db = _db()
    T.create_database(spark, db, location=str(tmp_path / "db"))
    logs = generate_service_logs(spark, 2000, seed=9, now="2024-01-30 12:00:00", batch_id="b", partitions=8)
    T.append(logs, f"{db}.plain", partition_by=["date_partition"], sort_within=["level"])
    T.append(logs, f"{db}.packed", partition_by=["date_partition"], sort_within=["level"], rebalance=True)
    files = lambda t: len(list((tmp_path / "db" / t).glob("*/*.parquet")))
    assert files("packed") < files("plain")
    a = sorted(map(tuple, spark.table(f"{db}.plain").collect()))
    assert a == sorted(map(tuple, spark.table(f"{db}.packed").collect()))


def test_app_fallback_tables_and_use_database(spark):
    db = _db()
    T.create_database(spark, db)
    rows = [(dt.datetime(2024, 1, 1, h), lvl, "m", f"lg{h % 2}", dt.date(2024, 1, 1)) for h, lvl in enumerate(["ERROR", "WARN", "INFO"] * 3)]
    logs = spark.createDataFrame(rows, "timestamp timestamp_ntz, level string, message string, logger string, partition_date date")
    T.append(logs, f"{db}.logs", partition_by=["partition_date"])
    out = J.run_aggregation(spark, f"{db}.logs", db, fallback="app")
    assert out.success and sorted(n for n, _ in out.table_counts) == ["daily_log_summary", "top_errors_by_count"]
    before = T.current_database(spark)
    T.use_database(spark, db)
    try:
        assert T.current_database(spark) == db and spark.table("top_errors_by_count").count() == 4
    finally:
        T.use_database(spark, before)


def test_scale_conf():
    from logloom.session import scale_conf

    big = scale_conf(100 << 40, 8000)  # 100 TB on 8000 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert int(scale_conf(100 << 40, 1000, max_partitions=5000)["spark.sql.shuffle.partitions"]) == 5000
    small = scale_conf(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(scale_conf(1 << 40, 1000)["spark.sql.shuffle.partitions"]) == 4096


def test_replace_table_is_safe(spark):
    """A full refresh may read the table it replaces, and a failed refresh leaves the old
    table as it was."""
    db = _db()
    T.create_database(spark, db)
    table = f"{db}.numbers"
    T.replace_table(spark.range(5).withColumnRenamed("id", "n"), table)
    T.replace_table(spark.table(table).select((F.col("n") * 10).alias("n")), table)  # reads itself
    assert sorted(r["n"] for r in spark.table(table).collect()) == [0, 10, 20, 30, 40]
    failing = spark.table(table).select(F.when(F.col("n") > 20, F.raise_error(F.lit("boom"))).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception):
        T.replace_table(failing, table)
    assert sorted(r["n"] for r in spark.table(table).collect()) == [0, 10, 20, 30, 40]
    T.replace_table(spark.range(2).withColumnRenamed("id", "n"), table)  # a left-over staged table is no obstacle
    assert spark.table(table).count() == 2
    assert [t.name for t in spark.catalog.listTables(db) if not t.isTemporary] == ["numbers"]


def test_single_pass_ingest_equals_two_pass(spark, tmp_path):
    """Good rows and rejects from one job equal those of the two-pass ingest; a second run
    appends; the parse runs once; tables elsewhere are refused."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text("\n".join(ACCESS.format(i=i, status=200 + 100 * (i % 4)) for i in range(1, 8)) + "\nnot a line\n")
    (raw / "b.json").write_text('{"timestamp": "2025-08-25T06:00:00.000Z", "level": "ERROR", "message": "x"}\n{oops\n')
    db = _db()
    ts = "2025-09-01 00:00:00"
    two = J.ingest_logs(spark, str(raw), f"{db}.logs2", ingest_ts=ts, quarantine_table=f"{db}.rejects2")
    root = str(tmp_path / "lake")
    one = J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", root, ingest_ts=ts)
    assert (one.rows_written, one.rows_quarantined) == (two.rows_written, two.rows_quarantined) == (8, 2)
    logs, logs2 = spark.table(f"{db}.logs"), spark.table(f"{db}.logs2")
    assert logs.columns == logs2.columns
    assert sorted(logs.collect()) == sorted(logs2.collect())
    rejects = spark.table(f"{db}.rejects")
    assert rejects.columns == ["format", "value", "reason", "partition_date"]
    assert sorted(rejects.drop("partition_date").collect()) == sorted(spark.table(f"{db}.rejects2").collect())
    assert {r["partition_date"] for r in rejects.collect()} == {dt.date(2025, 9, 1)}
    assert {r["partition_date"] for r in logs.collect()} == {dt.date(2025, 8, 25)}
    J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", root, ingest_ts=ts)
    assert spark.table(f"{db}.logs").count() == 16 and spark.table(f"{db}.rejects").count() == 4
    with pytest.raises(ValueError):
        J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", str(tmp_path / "elsewhere"), ingest_ts=ts)


def test_single_pass_ingest_parses_once(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text(ACCESS.format(i=1, status=200) + "\n")
    plans = []
    from pyspark.sql import DataFrameWriter

    original = DataFrameWriter.parquet

    def spy(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return original(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    db = _db()
    J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", str(tmp_path / "lake"))
    assert len(plans) == 1 and plans[0].count("regexp_replace") == 1


def test_single_pass_ingest_repairs_unregistered_partitions(spark, tmp_path):
    """A run whose files were committed but whose partitions were never registered (stopped
    between the write and the registration) is picked up by the next run."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text(ACCESS.format(i=1, status=200) + "\nnot a line\n")
    db = _db()
    root = str(tmp_path / "lake")
    J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", root, ingest_ts="2025-09-01 00:00:00")
    # forget the partitions (external tables: the files stay), as if the first run had stopped
    spark.sql(f"ALTER TABLE {db}.logs DROP PARTITION (partition_date = '2025-08-25')")
    spark.sql(f"ALTER TABLE {db}.rejects DROP PARTITION (partition_date = '2025-09-01')")
    assert spark.table(f"{db}.logs").count() == 0 and spark.table(f"{db}.rejects").count() == 0
    J.ingest_logs_single_pass(spark, str(raw), f"{db}.logs", f"{db}.rejects", root, ingest_ts="2025-09-01 00:00:00")
    assert spark.table(f"{db}.logs").count() == 2 and spark.table(f"{db}.rejects").count() == 2


def test_replace_cut_off_between_the_renames_recovers(spark, monkeypatch):
    """A replacement that changes the columns goes by renames. With the old table renamed aside and the staged
    one not yet in place, a full copy exists, and the next replacement (or recover_table) brings the old
    table back before it starts."""
    db = _db()
    T.create_database(spark, db)
    table = f"{db}.numbers"
    T.replace_table(spark.range(5).toDF("n"), table)
    run, seen = spark.sql, []

    def failing(text, *args, **kwargs):
        if "RENAME TO" in text:
            seen.append(text)
            if len(seen) == 2:
                raise RuntimeError("cut off")
        return run(text, *args, **kwargs)

    monkeypatch.setattr(spark, "sql", failing)
    with pytest.raises(RuntimeError):
        T.replace_table(spark.range(2).selectExpr("id AS n", "'x' AS more"), table)
    monkeypatch.setattr(spark, "sql", run)
    assert not T.table_exists(spark, table)
    assert T.table_row_counts(spark, db, exclude=()).count() == 0  # working copies are not reported
    assert T.recover_table(spark, table) and spark.table(table).count() == 5
    T.replace_table(spark.table(table).where("n > 2"), table)
    assert sorted(r.n for r in spark.table(table).collect()) == [3, 4]


def test_refresh_after_aggregate_drops_emptied_days(spark):
    db = _db()
    T.create_database(spark, db)
    rows = [(dt.datetime(2024, 1, d, 1), "INFO", "m", "s", "u", "x", "i", dt.date(2024, 1, d)) for d in (1, 2, 3)]
    schema = "timestamp timestamp_ntz, level string, message string, source string, user_id string, session_id string, ip_address string, date_partition date"
    T.append(spark.createDataFrame(rows, schema), f"{db}.logs", partition_by=["date_partition"])
    J.run_aggregation(spark, f"{db}.logs", db, kind="service")
    spark.sql(f"ALTER TABLE {db}.logs DROP PARTITION (date_partition = DATE'2024-01-03')")
    J.refresh_daily_summaries(spark, f"{db}.logs", db, days=1, as_of="2024-01-03")
    got = spark.table(f"{db}.daily_log_summary")
    assert [str(r.date_partition) for r in got.orderBy("date_partition").collect()] == ["2024-01-01", "2024-01-02"]
    assert "aggregation_timestamp" in got.columns
