"""Repeatable batches, the file ledger, mergeable rollups, replacement by pointer, newest rows, plans."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import bitmaps
from logloom.operators import summaries as Q
from logloom.plans import batches, pipelines, rollups
from logloom.plans import tables as T

ACCESS = '10.0.0.{i} - - [{d:02d}/Aug/2025:06:00:00 +0000] "GET /p{i} HTTP/1.1" 200 {i} "-" "ua"'


@pytest.fixture
def db(spark):
    name = "inc_" + uuid.uuid4().hex[:10]
    T.create_database(spark, name)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def folder_of(spark, db):
    rows = spark.sql(f"DESCRIBE DATABASE {db}").where("info_name = 'Location'").first()
    return Path(rows["info_value"].removeprefix("file:"))


# Bitmaps and dictionaries


def test_bitmap_states_merge_exactly(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"), (F.col("id") * 7 % 90_001 + 1).alias("n"))
    rows = rows.withColumn("n", F.when(F.col("n") % 11 != 0, F.col("n")))
    found = bitmaps.states(rows, ["g", "h"], "n")
    for groups in (["g"], ["h"], ["g", "h"]):
        want = rows.groupBy(*groups).agg(F.count_distinct("n").alias("k"))
        assert sorted(map(tuple, bitmaps.counts(found, groups, "k").collect())) == sorted(map(tuple, want.collect()))
    assert bitmaps.counts(found.where("g > 5"), ["g"], "k").count() == 0


def test_dictionary_ids_are_dense_and_stay(spark, db):
    first = rollups.extend_dictionary(spark, f"{db}.ids", spark.range(500).select(F.concat(F.lit("u"), F.col("id")).alias("v")))
    before = {r["value"]: r["id"] for r in first.collect()}
    more = spark.range(300, 900).select(F.when(F.col("id") < 890, F.concat(F.lit("u"), F.col("id"))).alias("v"))
    after = {r["value"]: r["id"] for r in rollups.extend_dictionary(spark, f"{db}.ids", more.unionAll(more)).collect()}
    assert sorted(before.values()) == list(range(1, 501)) and sorted(after.values()) == list(range(1, 891))
    assert all(after[v] == i for v, i in before.items())


# Rollups


def service_rows(spark, rows):
    schema = schemas.LOGS_SERVICE
    full = [(t, level, "m", source, user, "s", "1.1.1.1", dt.datetime(2024, 2, 1), "b", day) for t, level, source, user, day in rows]
    return spark.createDataFrame(full, schema)


def day(n):
    return dt.date(2024, 1, n)


def at(n, hour):
    return dt.datetime(2024, 1, n, hour, 5)


def test_refresh_equals_a_rebuild_with_lost_days_and_rows_without_a_time(spark, db):
    old = [(at(1, 3), "ERROR", "a", "u1", day(1)), (at(1, 3), "ERROR", "b", "u2", day(1)), (None, "WARN", "a", "u1", day(1)), (at(2, 4), None, None, None, day(2)), (at(3, 1), "ERROR", "a", "u3", day(3))]
    new = [(at(2, 4), "ERROR", "c", "u1", day(2)), (at(2, 5), "ERROR", "c", "u9", day(2)), (None, "WARN", "b", "u4", day(2)), (at(4, 1), "INFO", "a", "u1", day(4))]
    source = f"{db}.logs"
    T.append(service_rows(spark, old), source, partition_by=["date_partition"])
    rollups.refresh_summaries(spark, source, db, days=None)
    spark.sql(f"ALTER TABLE {source} DROP PARTITION (date_partition = '2024-01-03')")
    T.append(service_rows(spark, new), source, partition_by=["date_partition"])
    rollups.refresh_summaries(spark, source, db, days=2, as_of="2024-01-04")
    logs = spark.table(source)
    for name in ("daily_log_summary", "hourly_error_trends", "source_activity_summary"):
        got = spark.table(f"{db}.{name}").drop("aggregation_timestamp")
        want = Q.SERVICE_SUMMARIES[name](logs)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr), name
    users = {r["level"]: r["unique_users"] for r in rollups.window_users(spark, db, days=3, as_of="2024-01-04").collect()}
    assert users == {"ERROR": 3, "WARN": 2, "INFO": 1}  # u3 went with its day


def test_refresh_reads_only_its_days(spark, db):
    source = f"{db}.logs"
    T.append(service_rows(spark, [(at(n, 1), "ERROR", "a", "u", day(n)) for n in range(1, 20)]), source, partition_by=["date_partition"])
    inside = spark.table(source).where(F.col("date_partition") >= F.date_sub(F.lit("2024-01-19").cast("date"), 1))
    assert "PartitionFilters: [isnotnull(date_partition" in plan_of(Q.hourly_rollup(inside, "date_partition", "source"))


# Ledger


def test_ledger_takes_thousands_of_small_files_in_batches(spark, db, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(2500):
        (raw / f"f{i:05d}.log").write_text(ACCESS.format(i=i % 250, d=1 + i % 28) + "\n")
    ledger, archive = str(tmp_path / "ledger"), str(tmp_path / "archive")
    done = batches.ingest_new_files(spark, str(raw), f"{db}.logs", ledger, max_files=1000, archive=archive)
    assert [d.files for d in done] == [1000, 1000, 500] and sum(d.rows for d in done) == 2500
    assert spark.table(f"{db}.logs").count() == 2500 and not list(raw.iterdir())
    assert batches.ingest_new_files(spark, str(raw), f"{db}.logs", ledger) == []
    assert sum(1 for p in Path(archive).rglob("*") if p.is_file() and not p.name.startswith(".")) == 2500


def test_ledger_finishes_a_batch_that_was_cut_off(spark, db, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text(ACCESS.format(i=1, d=1) + "\nnot a line\n")
    (raw / "b.json").write_text('{"level": "ERROR", "message": "x"}\n')
    ledger = str(tmp_path / "ledger")
    write = T.append_batch

    def cut_off(df, table, *args, **kw):
        if table.endswith("_rejects"):
            raise RuntimeError("killed")
        write(df, table, *args, **kw)

    monkeypatch.setattr(T, "append_batch", cut_off)
    with pytest.raises(RuntimeError, match="killed"):
        batches.ingest_new_files(spark, str(raw), f"{db}.logs", ledger)
    monkeypatch.setattr(T, "append_batch", write)
    (raw / "late.log").write_text(ACCESS.format(i=2, d=2) + "\n")
    done = batches.ingest_new_files(spark, str(raw), f"{db}.logs", ledger)
    assert [(d.files, d.rows, d.rejects) for d in done] == [(2, 2, 1), (1, 1, 0)]
    assert spark.table(f"{db}.logs").count() == 3 and spark.table(f"{db}.logs_rejects").count() == 1
    assert spark.table(f"{db}.logs").where("logger = 'unknown'").first()["timestamp"] is not None  # the planned time


# Repeated batches


def test_batch_replaces_itself_and_nothing_else(spark, db):
    table = f"{db}.t"

    def rows(days, n=3):
        return spark.createDataFrame([(i, day(d)) for d in days for i in range(n)], "v int, d date")

    T.append_batch(rows([1, 2]), table, "one", partition_by=["d"])
    T.append_batch(rows([2, 3]), table, "two", partition_by=["d"])
    T.append_batch(rows([1, 2, 4], 5), table, "one", partition_by=["d"])  # repeated, with more
    T.append_batch(rows([2], 2), table, "one", partition_by=["d"])  # repeated, with fewer days
    got = {(r["d"], r[T.BATCH]): r["count"] for r in spark.table(table).groupBy("d", T.BATCH).count().collect()}
    assert got == {(day(2), "one"): 2, (day(2), "two"): 3, (day(3), "two"): 3}
    T.append_batch(rows([]), table, "two", partition_by=["d"])
    assert spark.table(table).count() == 2


def test_ingest_without_batch_appends(spark, db, tmp_path):
    (tmp_path / "a.log").write_text(ACCESS.format(i=1, d=1) + "\n")
    for _ in range(2):
        pipelines.ingest_logs(spark, str(tmp_path), f"{db}.logs")
    assert spark.table(f"{db}.logs").count() == 2


# Registration


def test_single_pass_registers_the_written_days_without_a_listing(spark, db, tmp_path, monkeypatch):
    root = tmp_path / "lake"
    for i in range(1000):  # a lake of many days, not registered
        (root / "outcome=logs" / f"partition_date={dt.date(2020, 1, 1) + dt.timedelta(i)}").mkdir(parents=True)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.log").write_text(ACCESS.format(i=1, d=1) + "\n" + ACCESS.format(i=2, d=7) + "\nno line\n")
    listed = []
    monkeypatch.setattr(T, "recover_partitions", lambda spark, table: listed.append(table))
    run = lambda: pipelines.ingest_logs_single_pass(spark, str(tmp_path / "raw"), f"{db}.logs", f"{db}.bad", str(root), ingest_ts="2025-09-01 00:00:00")
    assert (run().rows_written, listed) == (2, [])
    assert [r[0] for r in spark.sql(f"SHOW PARTITIONS {db}.logs").collect()] == ["partition_date=2025-08-01", "partition_date=2025-08-07"]
    assert spark.table(f"{db}.logs").count() == 2 and spark.table(f"{db}.bad").count() == 1
    T.mark_pending(spark, str(root))  # as a run leaves that was stopped before it registered
    run()
    assert listed == [f"{db}.logs", f"{db}.bad"] and not T.pending_marks(spark, str(root))


# Replacement


def test_readers_never_fail_during_replacements(spark, db):
    table = f"{db}.t"
    T.replace_table(spark.range(1000).withColumn("g", F.lit(0)), table)
    stop, seen, errors = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                r = spark.table(table).agg(F.count("id"), F.min("g"), F.max("g")).first()
                seen.add(tuple(r))
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    readers = [threading.Thread(target=read) for _ in range(2)]
    [r.start() for r in readers]
    for g in range(1, 8):
        T.replace_table(spark.range(1000).withColumn("g", F.lit(g)), table)
    stop.set()
    [r.join() for r in readers]
    assert not errors and all(n == 1000 and low == high for n, low, high in seen)
    assert spark.table(table).first()["g"] == 7
    T.drop_old_versions(spark, table, keep_seconds=0)
    assert len(T.versions(spark, table)) == 1 and spark.table(table).count() == 1000


@pytest.mark.parametrize("partition_by", [(), ("g",)])
def test_failed_replacement_leaves_nothing(spark, db, partition_by):
    table = f"{db}.t"
    T.replace_table(spark.range(10).withColumn("g", F.col("id") % 2), table, partition_by=partition_by)
    before = sorted(p.name for p in folder_of(spark, db).iterdir())
    bad = spark.range(10).withColumn("g", F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id") % 2))
    other = bad.withColumn("more", F.lit(1)).select("id", "more", "g")
    for df in (bad, other):
        with pytest.raises(Exception, match="no"):
            T.replace_table(df, table, partition_by=partition_by)
    assert sorted(p.name for p in folder_of(spark, db).iterdir()) == before
    assert spark.table(table).count() == 10 and [t.name for t in spark.catalog.listTables(db)] == ["t"]


def test_partitioned_tables_are_replaced(spark, db):
    table = f"{db}.t"
    for n in (10, 6):
        T.replace_table(spark.range(n).withColumn("g", F.col("id") % 5), table, partition_by=["g"], keep_seconds=0)
    assert sorted(r["id"] for r in spark.table(table).collect()) == list(range(6))
    T.replace_table(spark.table(table).where("g < 2"), table, partition_by=["g"], keep_seconds=0)
    assert sorted(r["id"] for r in spark.table(table).collect()) == [0, 1, 5]
    T.replace_table(spark.table(table).withColumn("h", F.lit("x")), table, partition_by=["h"], keep_seconds=0)  # another shape
    assert sorted(map(tuple, spark.table(table).select("id", "g", "h").collect())) == [(0, 0, "x"), (1, 1, "x"), (5, 0, "x")]
    tracked = f"{db}.tracked"
    T.append(spark.range(4).withColumn("g", F.col("id") % 2), tracked, partition_by=["g"])
    T.replace_table(spark.range(2).withColumn("g", F.lit(9).cast("long")), tracked, partition_by=["g"])
    assert sorted(map(tuple, spark.table(tracked).collect())) == [(0, 9), (1, 9)]


def test_dropped_and_replaced_anew(spark, db):
    table = f"{db}.t"
    for n in (3, 4, 5):
        T.replace_table(spark.range(n), table, keep_seconds=0)
    spark.sql(f"DROP TABLE {table}")
    T.replace_table(spark.range(2), table)
    assert spark.table(table).count() == 2


# Newest rows


def test_newest_rows_read_at_most_two_partitions(spark, db):
    table = f"{db}.logs"
    rows = [(at(n, h), "INFO", f"s{k}", "u", day(n)) for n in range(1, 29) for h in range(3) for k in range(2)]
    rows += [(None, "INFO", "late", None, day(28))] * 3
    T.append(service_rows(spark, rows), table, partition_by=["date_partition"])
    got = Q.latest_rows_of_table(spark, table, date_column="date_partition", n=10)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, Q.latest_rows(spark.table(table), n=10).collect()), key=repr)
    assert "date_partition" in plan_of(got) and "2024-01-27" in str(got._jdf.queryExecution().executedPlan().toString())
    assert got.inputFiles() and all("date_partition=2024-01-2" in f for f in spark.table(table).where("date_partition >= '2024-01-27'").inputFiles())
    for n in (len(rows) - 1, len(rows) + 5):  # rows without a time are needed
        got = Q.latest_rows_of_table(spark, table, date_column="date_partition", n=n)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, Q.latest_rows(spark.table(table), n=n).collect()), key=repr)


# Plans


def test_distinct_counts_without_expand(spark, db):
    table = f"{db}.logs"
    T.append(service_rows(spark, [(at(1, 1), "ERROR", "a", "u", day(1))]), table, partition_by=["date_partition"])
    logs = spark.table(table)
    for df in (Q.user_activity_summary(logs), Q.ip_address_analysis(logs)):
        assert "Expand" not in plan_of(df)


def test_loggers_are_gathered_for_the_top_groups_only(spark):
    rows = [("ERROR", f"e{i % 200}" if i % 3 else None, None, f"l{i % 7}", at(1, i % 24)) for i in range(3000)]
    logs = spark.createDataFrame(rows, "level string, exception_class string, exception_message string, logger string, timestamp timestamp_ntz")
    found = Q.exception_summary(logs, limit=5)
    top = found.collect()
    assert len(top) == 5 and top[0]["exception_class"] == "No Exception" and top[0]["affected_loggers"] == [f"l{i}" for i in range(7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_set") < plan.index("LeftSemi")  # printed root first: the set stands above the semi join


# Compaction


def test_small_files_become_few(spark, db):
    table = f"{db}.t"
    rows = spark.range(6000).select(F.col("id"), F.expr("date_add(DATE'2024-01-01', cast(id % 3 as int))").alias("d"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    T.append(rows.repartition(20), table, partition_by=["d"])
    T.append(rows.where("id = 0").withColumn("d", F.lit("2024-02-01").cast("date")), table, partition_by=["d"])  # one file: stays

    def state():
        sizes = T.file_sizes(spark, table, ["d"]).groupBy("d").count().collect()
        return {str(r["d"]): r["count"] for r in sizes}, spark.table(table).agg(F.count("id"), F.sum("id"), F.sum(F.xxhash64("id", "d", "x") % 1000)).first()

    before, content = state()
    assert set(before.values()) == {20, 1}
    reader = spark.table(table)
    reader.count()
    assert T.compact_table(spark, table, partition_by=["d"], target_bytes=100_000, min_files=4) == 3
    after, same = state()
    need = 6000 * 70 // 3 // 100_000 + 2
    assert same == content and all(n <= need for n in after.values()) and after["2024-02-01"] == 1
    assert reader.count() == 6001  # planned before: its files are still there
    T.append(rows.where("id < 3"), table, partition_by=["d"])  # goes on in the new places
    assert spark.table(table).count() == 6004
    assert T.compact_table(spark, table, partition_by=["d"], target_bytes=100_000, keep_seconds=0) == 0
    folders = [p.name for p in (folder_of(spark, db) / "t").iterdir() if p.is_dir()]
    assert len([f for f in folders if f.startswith(T.COMPACTED)]) == 1 and "d=2024-02-01" in folders and "d=2024-01-01" not in folders
    assert spark.table(table).count() == 6004


def test_failed_compaction_changes_nothing(spark, db, monkeypatch):
    table = f"{db}.t"
    T.append(spark.range(100).withColumn("d", F.lit(1)).repartition(10), table, partition_by=["d"])
    monkeypatch.setattr(T, "_run_name", lambda: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        T.compact_table(spark, table, partition_by=["d"])
    assert spark.table(table).count() == 100 and T.file_sizes(spark, table, ["d"]).count() == 10
