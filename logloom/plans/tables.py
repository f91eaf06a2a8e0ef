"""Databases, tables and writes on the session catalog.

``fmt`` is the table format: ``parquet`` by default (always available); ``iceberg`` or
another format when its catalog and jar are configured. Writes are whole-DataFrame jobs:
executors write their partitions in parallel and the driver only commits.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _quote(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _columns_ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS``, optionally at a given location."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quote(name)}{where}")


def create_table(
    spark: SparkSession,
    table: str,
    schema: StructType,
    *,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    properties: Mapping[str, str] | None = None,
    location: str | None = None,
) -> None:
    """Create a (partitioned) table if it does not exist; an existing table is left as it is."""
    parts = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partition_by)})" if partition_by else ""
    props = ""
    if properties:
        props = " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")"
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quote(table)} ({_columns_ddl(schema)}) USING {fmt}{parts}{where}{props}"
    )


def recreate_table(
    spark: SparkSession, table: str, schema: StructType, *, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> None:
    """Drop the table if it exists and create it empty with the given schema and partitioning."""
    spark.sql(f"DROP TABLE IF EXISTS {_quote(table)}")
    writer = spark.createDataFrame([], schema).write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def append(
    df: DataFrame,
    table: str,
    *,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    max_records_per_file: int | None = None,
    sort_within: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Append to a table (created on first write), partitioned by date.

    No shuffle: each task writes the dates its input split holds (the writer sorts a task's
    rows by the partition columns, so one file is open at a time). Clustering by date first
    would send a whole day to one task, the worst case when one day holds most rows.
    ``max_records_per_file`` caps file size for tasks holding much of one day.
    ``sort_within`` extends that per-task sort (no shuffle) with more columns, e.g.
    ``level``: row groups then hold few levels, and level filters skip row groups by their
    min/max statistics.

    ``rebalance=True`` trades one shuffle for fewer, fuller files: rows are regrouped by the
    partition columns with an AQE rebalance, which targets
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` per task and splits a skewed (hot)
    date over several tasks instead of sending it to one.
    """
    if rebalance and partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_within:
        df = df.sortWithinPartitions(*partition_by, *sort_within)
    writer = df.write.mode("append").format(fmt).option("compression", "snappy")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(max_records_per_file))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


# Marks, inside a table name, a replacement being written and a table moved aside by one.
STAGED_MARK, OLD_MARK = "__staged_", "__old_"


def _siblings(spark: SparkSession, table: str, mark: str) -> list[str]:
    """Full names of the tables that a replacement of ``table`` has left under ``mark``, oldest first."""
    database, _, name = table.rpartition(".")
    found = spark.catalog.listTables(database or None)
    return sorted((f"{database}." if database else "") + t.name for t in found if not t.isTemporary and t.name.startswith((name + mark).lower()))


def _run_name() -> str:
    return f"{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"


def recover_table(spark: SparkSession, table: str) -> bool:
    """After a replacement that was cut off between its two renames: give the table that was moved
    aside its name back. True if that was needed. (Replacements call it first.)"""
    if table_exists(spark, table):
        return False
    aside = _siblings(spark, table, OLD_MARK)
    if aside:
        spark.sql(f"ALTER TABLE {_quote(aside[-1])} RENAME TO {_quote(table)}")
    return bool(aside)


# Folders of a replaced table, beside its first folder: <table>__v_<run>. Versions stay readable for
# so long after the last write into them, so that queries planned on them can end.
VERSION_MARK = "__v_"
KEEP_SECONDS = 3600


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, fs = _file_system(spark, folder)
    fs.delete(path, True)


def _shape(spark: SparkSession, table: str) -> tuple[list[tuple[str, str]], list[str], bool]:
    """Columns with types, partition columns, and whether the catalog tracks single partitions."""
    columns = spark.catalog.listColumns(table)
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quote(table)}").where("col_name = 'Partition Provider'").collect()
    return [(c.name, c.dataType) for c in columns], [c.name for c in columns if c.isPartition], bool(rows)


def _untracked(spark: SparkSession, write: Callable[[], None]) -> None:
    """Runs ``write`` so that a partitioned table it creates finds its partitions by listing its folder,
    not by catalog entries with a location each: one pointer then names all of it."""
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        write()
    finally:
        spark.conf.set(key, before)


def _save_new(df: DataFrame, table: str, fmt: str, partition_by: Sequence[str]) -> None:
    writer = df.write.format(fmt)
    if partition_by:
        _untracked(df.sparkSession, lambda: writer.partitionBy(*partition_by).saveAsTable(table))
    else:
        writer.saveAsTable(table)


def versions(spark: SparkSession, table: str) -> list[str]:
    """Folders that hold or held the table: the current one first, then the others, newest first."""
    current = table_location(spark, table)
    parent, fs = _file_system(spark, current.rstrip("/").rsplit("/", 1)[0])
    name = table.rpartition(".")[2].lower()
    found = [s for s in fs.listStatus(parent) if s.isDirectory() and (s.getPath().getName() == name or s.getPath().getName().startswith(name + VERSION_MARK))]
    here = spark._jvm.org.apache.hadoop.fs.Path(current).toUri().getPath()
    others = sorted(((s.getModificationTime(), s.getPath().toString()) for s in found if s.getPath().toUri().getPath() != here), reverse=True)
    return [current, *[path for _, path in others]]


def drop_old_versions(spark: SparkSession, table: str, *, keep_seconds: float = KEEP_SECONDS, keep: Sequence[str] = ()) -> None:
    """Delete the folders that ``table`` no longer uses and nobody wrote into for ``keep_seconds``: earlier
    versions, and what a killed writer left. ``keep``: folders to leave as well."""
    stay = {spark._jvm.org.apache.hadoop.fs.Path(k).toUri().getPath() for k in keep}
    before = (time.time() - keep_seconds) * 1000
    for folder in versions(spark, table)[1:]:
        path, fs = _file_system(spark, folder)
        if path.toUri().getPath() not in stay and fs.getFileStatus(path).getModificationTime() <= before:
            fs.delete(path, True)


def replace_table(df: DataFrame, table: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (), keep_seconds: float = KEEP_SECONDS) -> None:
    """Create or replace a table from a DataFrame (full refresh).

    Iceberg-style catalogs replace atomically (``createOrReplace``). A Parquet table is not
    overwritten in place (Spark would delete the old files before the job runs). The rows are written to
    a new version folder beside the table's, and when that job has succeeded one catalog change
    (``ALTER TABLE ... SET LOCATION``) points the table to it. Nothing is moved or copied, the table exists at
    every moment, and its readers see the old rows or the new ones. A failed write deletes its folder and leaves
    the table as it was. Queries planned before keep reading the version they were planned on: it stays
    until a replacement finds that it was superseded earlier than the last one and is older than
    ``keep_seconds`` (``drop_old_versions``; that also takes what a killed writer left). ``df`` may read
    ``table`` itself; of two replacements at once the later one stays.

    Partitioned tables made here list their folder (the catalog holds no entry per partition), so they are
    replaced the same way. A table whose columns or partitioning change, or whose partitions are tracked one
    by one, is swapped by renames instead: the rows go to a staged table, the old one is renamed aside, the
    staged one gets its name, the old one is dropped (``recover_table`` undoes a cut-off swap).
    """
    if fmt != "parquet":
        writer2 = df.writeTo(table).using(fmt)
        if partition_by:
            writer2 = writer2.partitionedBy(*[F.col(p) for p in partition_by])
        writer2.createOrReplace()
        return
    spark = df.sparkSession
    recover_table(spark, table)
    if not table_exists(spark, table):
        _save_new(df, table, fmt, partition_by)
        return
    columns, parts, tracked = _shape(spark, table)
    ordered = [f for f in df.schema.fields if f.name not in partition_by] + [df.schema[p] for p in partition_by]
    same = columns == [(f.name, f.dataType.simpleString()) for f in ordered] and parts == list(partition_by)
    run = _run_name()
    if same and not tracked:
        before = table_location(spark, table)
        folder = f"{before.rstrip('/').rsplit('/', 1)[0]}/{table.rpartition('.')[2].lower()}{VERSION_MARK}{run}"
        try:
            df.write.format(fmt).partitionBy(*partition_by).save(folder)
        except BaseException:
            _delete(spark, folder)
            raise
        spark.sql(f"ALTER TABLE {_quote(table)} SET LOCATION '{folder}'")
        drop_old_versions(spark, table, keep_seconds=keep_seconds, keep=[before])
        return
    staged, aside = table + STAGED_MARK + run, table + OLD_MARK + run
    try:
        _save_new(df, staged, fmt, partition_by)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {_quote(staged)}")
        database = spark.sql(f"DESCRIBE DATABASE {_quote(table.rpartition('.')[0] or current_database(spark))}").where("info_name = 'Location'").first()
        _delete(spark, f"{database['info_value'].rstrip('/')}/{staged.rpartition('.')[2].lower()}")
        raise
    spark.sql(f"ALTER TABLE {_quote(table)} RENAME TO {_quote(aside)}")
    spark.sql(f"ALTER TABLE {_quote(staged)} RENAME TO {_quote(table)}")
    for name in _siblings(spark, table, OLD_MARK):  # this run's, and any that a cut-off run left
        spark.sql(f"DROP TABLE IF EXISTS {_quote(name)}")


def is_working_copy(name: str) -> bool:
    """Whether a table name is a staged or set-aside copy of ``replace_table``."""
    return STAGED_MARK in name or OLD_MARK in name


def overwrite_partitions(df: DataFrame, table: str, *, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Replace only the partitions of ``table`` that ``df`` has rows for (dynamic partition
    overwrite); other partitions stay as they are. The table is created, partitioned by
    ``partition_by``, on first use. ``df`` must not read ``table`` itself."""
    spark = df.sparkSession
    if not table_exists(spark, table):
        df.write.format(fmt).partitionBy(*partition_by).saveAsTable(table)
        return
    ordered = df.select(*spark.table(table).columns)  # insertInto matches columns by position
    key = "spark.sql.sources.partitionOverwriteMode"
    previous = spark.conf.get(key, None)
    spark.conf.set(key, "dynamic")  # insertInto reads the mode from the session, not the writer
    try:
        ordered.write.insertInto(table, overwrite=True)
    finally:
        if previous is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, previous)


BATCH = "ingest_batch"


def append_batch(df: DataFrame, table: str, batch_id: str, *, partition_by: Sequence[str] = (), fmt: str = "parquet", sort_within: Sequence[str] = ()) -> None:
    """Append the rows of one batch, once: the table is also partitioned by ``ingest_batch``, and a batch that
    was appended before, whole or half, is replaced by what is given now.

    The write is a dynamic partition overwrite of the batch's own partitions, so no other batch is read or
    touched; partitions that an earlier attempt of the batch wrote and this one has no rows for are dropped
    after it. Formats with row-level commits replace the batch's partitions by ``overwritePartitions``.
    """
    spark = df.sparkSession
    parts = [*partition_by, BATCH]
    df = df.withColumn(BATCH, F.lit(batch_id))
    if sort_within:
        df = df.sortWithinPartitions(*partition_by, *sort_within)
    if fmt != "parquet":
        if table_exists(spark, table):
            df.writeTo(table).overwritePartitions()
        else:
            df.writeTo(table).using(fmt).partitionedBy(*[F.col(p) for p in parts]).create()
        return
    seen = Observation("batch")
    key = F.concat_ws("/", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parts])
    overwrite_partitions(df.observe(seen, F.collect_set(key).alias("written")), table, partition_by=parts, fmt=fmt)
    written = set(seen.get["written"])
    for row in spark.sql(f"SHOW PARTITIONS {_quote(table)} PARTITION ({BATCH} = '{batch_id}')").collect():
        if row["partition"] not in written:
            spec = ", ".join("{} = '{}'".format(*x.split("=", 1)) for x in row["partition"].split("/"))
            spark.sql(f"ALTER TABLE {_quote(table)} DROP IF EXISTS PARTITION ({spec})")


def add_partitions(spark: SparkSession, table: str, column: str, values: Iterable[str]) -> None:
    """Register the partitions ``column=value`` of ``values``, whose folders stand under the table's: no listing."""
    specs = " ".join(f"PARTITION (`{column}` = '{v}')" for v in sorted(values))
    if specs:
        spark.sql(f"ALTER TABLE {_quote(table)} ADD IF NOT EXISTS {specs}")


PENDING_MARK = "_unregistered_"


def mark_pending(spark: SparkSession, root: str) -> str:
    """Leaves a mark (a file that scans skip) under ``root``: files are being written whose partitions are
    not registered yet. Returns its path, for ``clear_mark``."""
    name = f"{root.rstrip('/')}/{PENDING_MARK}{_run_name()}"
    path, fs = _file_system(spark, name)
    fs.create(path, True).close()
    return name


def pending_marks(spark: SparkSession, root: str) -> list[str]:
    path, fs = _file_system(spark, root)
    if not fs.exists(path):
        return []
    return [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith(PENDING_MARK)]


def clear_mark(spark: SparkSession, mark: str) -> None:
    _delete(spark, mark)


COMPACTED = "_compacted_"


def file_sizes(spark: SparkSession, table: str, partition_by: Sequence[str]) -> DataFrame:
    """(partition columns, path, size) of the table's files, from their metadata (no data pages are read)."""
    meta = F.col("_metadata")
    return spark.table(table).select(*partition_by, meta["file_path"].alias("path"), meta["file_size"].alias("size")).distinct()


def compact_table(spark: SparkSession, table: str, *, partition_by: Sequence[str], target_bytes: int = 256 << 20, min_files: int = 4, sort_within: Sequence[str] = (), keep_seconds: float = KEEP_SECONDS) -> int:
    """Rewrite the partitions that hold many small files as few files of about ``target_bytes``; the number
    of partitions rewritten.

    A partition is rewritten if it has at least ``min_files`` files and twice as many as its bytes need. Its files
    are dealt to bins, each bin is one task and one output file, so a large day is spread over its bins. The
    new files stand in a hidden folder inside the table's, and one catalog change per partition (``PARTITION ...
    SET LOCATION``) puts them in the old ones' place: readers see the old files or the new ones, and a
    failed run changes nothing. Old folders stay readable for ``keep_seconds``; the first run after that
    deletes them. The driver sees one row per partition.
    """
    need = F.ceil(F.col("bytes") / target_bytes).cast("int")
    sizes = file_sizes(spark, table, partition_by).groupBy(*partition_by).agg(F.count("path").alias("files"), F.sum("size").alias("bytes"))
    found = sizes.where((F.col("files") >= min_files) & (F.col("files") >= 2 * need)).select(*partition_by, need.alias("_bins")).collect()
    location = table_location(spark, table).rstrip("/")
    _drop_replaced(spark, table, location, keep_seconds)
    if not found:
        return 0
    bins = spark.createDataFrame(found, sizes.select(*partition_by, need.alias("_bins")).schema)
    # A file's rows stay together; partitions are days, so the list of them is small.
    bin_of = F.pmod(F.xxhash64("_file"), F.col("_bins"))
    rows = spark.table(table).withColumn("_file", F.col("_metadata.file_path")).join(F.broadcast(bins), [*partition_by])
    rows = rows.repartition(sum(r["_bins"] for r in found), *partition_by, bin_of).sortWithinPartitions(*partition_by, *sort_within)
    folder = f"{location}/{COMPACTED}{_run_name()}"
    try:
        rows.drop("_file", "_bins").write.option("compression", "snappy").partitionBy(*partition_by).parquet(folder)
    except BaseException:
        _delete(spark, folder)
        raise
    for r in found:
        spec = ", ".join(f"`{p}` = '{r[p]}'" for p in partition_by)
        spark.sql(f"ALTER TABLE {_quote(table)} PARTITION ({spec}) SET LOCATION '{folder}/{'/'.join(f'{p}={r[p]}' for p in partition_by)}'")
    spark.catalog.refreshTable(table)
    return len(found)


def _drop_replaced(spark: SparkSession, table: str, location: str, keep_seconds: float) -> None:
    """Delete partition folders that the catalog no longer points to and nobody wrote into for ``keep_seconds``."""
    uri = lambda place: spark._jvm.org.apache.hadoop.fs.Path(place).toUri().getPath().rstrip("/")
    used = set()
    for r in spark.sql(f"SHOW PARTITIONS {_quote(table)}").collect():
        spec = ", ".join("`{}` = '{}'".format(*x.split("=", 1)) for x in r["partition"].split("/"))
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quote(table)} PARTITION ({spec})").where("col_name = 'Location'").collect()
        used |= {uri(x["data_type"]) for x in rows}
    root, fs = _file_system(spark, location)
    before, todo = (time.time() - keep_seconds) * 1000, [root]
    while todo:
        for s in fs.listStatus(todo.pop()):
            name, place = s.getPath().getName(), uri(s.getPath().toString())
            if not s.isDirectory() or not ("=" in name or name.startswith(COMPACTED)) or place in used:
                continue
            if any(u.startswith(place + "/") for u in used):
                todo.append(s.getPath())
            elif s.getModificationTime() <= before:
                fs.delete(s.getPath(), True)


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def table_location(spark: SparkSession, table: str) -> str:
    """The folder of a table, as the catalog records it (``DESCRIBE TABLE EXTENDED``)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quote(table)}").where(F.col("col_name") == "Location").collect()
    if not rows:
        raise ValueError(f"{table} has no location")
    return rows[0]["data_type"]


def recover_partitions(spark: SparkSession, table: str, missing_ok: bool = True) -> None:
    """Register the partition folders found under a table's location (``MSCK REPAIR TABLE``):
    needed after files were written to the folder directly rather than through the table.
    With ``missing_ok``, a location that does not exist yet (nothing written) is no error."""
    try:
        spark.catalog.recoverPartitions(table)
    except Exception as exc:
        if not (missing_ok and "FileNotFoundException" in str(exc)):
            raise


def build_tables(
    spark: SparkSession,
    logs: DataFrame,
    database: str,
    summaries: Mapping[str, Callable[..., DataFrame]],
    *,
    if_exists: str = "replace",
    fmt: str = "parquet",
    stamp: str | None = "now",
    at_once: int = 4,
) -> list[str]:
    """Write one summary table per entry of ``summaries`` (name -> query function).

    ``if_exists="replace"`` refreshes every table; ``"skip"`` leaves existing tables untouched
    (create-if-absent). Returns the names written. Each table is one job that reads only the
    columns its query needs; up to ``at_once`` jobs are submitted at a time, so that the tail of one
    leaves no executor idle.
    """
    if if_exists not in ("replace", "skip"):
        raise ValueError("if_exists must be 'replace' or 'skip'")
    todo = {f"{database}.{name}": query for name, query in summaries.items()}
    if if_exists == "skip":
        todo = {full: query for full, query in todo.items() if not table_exists(spark, full)}
    build = inheritable_thread_target(spark)(lambda full: replace_table(todo[full](logs, stamp=stamp), full, fmt=fmt))
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(build, todo))
    return list(todo)


def overwrite_path(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a folder with the DataFrame's rows (no catalog)."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def list_databases(spark: SparkSession) -> DataFrame:
    """Databases of the current catalog (``namespace`` column)."""
    return spark.sql("SHOW DATABASES")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a database (``namespace``, ``tableName``, ``isTemporary``)."""
    return spark.sql(f"SHOW TABLES IN {_quote(database)}")


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """Columns of a table (``col_name``, ``data_type``, ``comment``)."""
    return spark.sql(f"DESCRIBE TABLE {_quote(table)}")


def current_database(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()


def use_database(spark: SparkSession, name: str) -> None:
    """Make ``name`` the current database (``USE``)."""
    spark.catalog.setCurrentDatabase(name)


def table_row_counts(spark: SparkSession, database: str, exclude: Iterable[str] = ("logs",)) -> DataFrame:
    """(table_name, row_count) of every table of ``database`` except ``exclude`` (full names, or
    names in it) and working copies of replacements, as one job.

    The table names come from the catalog; the counts are computed by Spark, one aggregate per
    table combined with ``unionByName`` (Parquet counts read only footers and row groups).
    """
    skip = {x if "." in x else f"{database}.{x}" for x in exclude}
    found = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    names = [name for name in found if f"{database}.{name}" not in skip and not is_working_copy(name)]
    if not names:
        return spark.createDataFrame([], "table_name string, row_count bigint")
    counts = [
        spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in sorted(names)
    ]
    return reduce(DataFrame.unionByName, counts)
