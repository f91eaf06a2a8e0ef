"""Incremental batch ingest by a ledger of files.

Each run lists the raw files, takes away those that the ledger knows (a distributed anti join, whatever their
age), and ingests the rest in batches of at most ``max_files``. A batch is planned first (its files, one small
file in ``<ledger>/planned``), then appended by its id (``tables.append_batch``), then noted in
``<ledger>/done``. A run that was cut off leaves a planned batch that is not done: the next run ingests exactly
its files again, and its rows replace what was already there. So every file counts once, and the driver holds
one batch's file names and the listing of the raw folder, no history. With ``archive``, the files of finished
batches are moved there, which keeps that listing as short as what is still to be read.

One run at a time per ledger. A file is known by its path.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions.timeutil import ingest_time
from logloom.operators import parse as parse_ops
from logloom.plans import tables as T
from logloom.sources.files import ACCESS_GLOB, JSON_GLOB, tagged_records

MAX_FILES = 1000
PLANNED = "batch string, kind string, path string, length long, modified timestamp, planned_at timestamp_ntz"
DONE = "batch string, files long, rows long, rejects long"


@dataclass
class BatchResult:
    batch: str
    files: int
    rows: int
    rejects: int


def _ledger(spark: SparkSession, folder: str, fields: str) -> DataFrame:
    """A ledger table (empty before its first row)."""
    path, fs = T._file_system(spark, folder)
    return spark.read.schema(fields).parquet(folder) if fs.exists(path) else spark.createDataFrame([], fields)


def list_files(spark: SparkSession, prefix: str, globs: dict[str, str]) -> DataFrame:
    """(kind, path, length, modified) of the files under ``prefix`` that match each kind's glob; no
    content is read."""
    found = spark.createDataFrame([], "kind string, path string, length long, modified timestamp")
    for kind, glob in globs.items():
        try:
            files = spark.read.format("binaryFile").load(f"{prefix.rstrip('/')}/{glob}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        found = found.unionByName(files.select(F.lit(kind).alias("kind"), "path", "length", F.col("modificationTime").alias("modified")))
    return found


def plan_batch(spark: SparkSession, prefix: str, globs: dict[str, str], ledger: str, max_files: int) -> str | None:
    """Note the oldest ``max_files`` unknown files as the next batch; its id, or None if there are none."""
    known = _ledger(spark, f"{ledger}/planned", PLANNED).select("path")
    new = list_files(spark, prefix, globs).join(known, "path", "left_anti").orderBy("modified", "path").limit(max_files)
    if new.isEmpty():
        return None
    batch = T._run_name()
    rows = new.select(F.lit(batch).alias("batch"), "kind", "path", "length", "modified", ingest_time(None).alias("planned_at"))
    rows.coalesce(1).write.mode("append").parquet(f"{ledger}/planned")  # one file: planned as a whole, or not
    return batch


def open_batches(spark: SparkSession, ledger: str) -> list[str]:
    """Batches that were planned and not finished, oldest first."""
    planned = _ledger(spark, f"{ledger}/planned", PLANNED).select("batch").distinct()
    rows = planned.join(_ledger(spark, f"{ledger}/done", DONE), "batch", "left_anti").orderBy("batch").collect()
    return [r["batch"] for r in rows]


def run_batch(
    spark: SparkSession,
    batch: str,
    table: str,
    ledger: str,
    *,
    rejects: str | None = None,
    archive: str | None = None,
    ingest_ts: dt.datetime | str | None = None,
    allow_dash_size: bool = False,
    fmt: str = "parquet",
) -> BatchResult:
    """Ingest one planned batch (again, if need be) and note it as done."""
    files = _ledger(spark, f"{ledger}/planned", PLANNED).where(F.col("batch") == batch).orderBy("path").collect()  # at most max_files
    read = {k: [f["path"] for f in files if f["kind"] == k] for k in (parse_ops.FORMAT_ACCESS, parse_ops.FORMAT_JSON)}
    lines, values = (spark.read.text(paths) if paths else None for paths in read.values())
    # A repeated run stamps the same time.
    stamp = ingest_ts if ingest_ts is not None else files[0]["planned_at"]
    ingest = ingest_time(stamp)
    seen = Observation("ingest")
    records = parse_ops.count_lines(tagged_records(lines, values, ingest, allow_dash_size=allow_dash_size), seen)
    good, bad = parse_ops.split_quarantine(records)
    T.append_batch(parse_ops.to_logs_app(good, ingest), table, batch, partition_by=[schemas.LOGS_APP_PARTITION], fmt=fmt, sort_within=("level",))
    T.append_batch(bad, rejects or f"{table}_rejects", batch, fmt=fmt)
    counts = seen.get
    result = BatchResult(batch, len(files), int(counts["lines"]) - int(counts["quarantined"]), int(counts["quarantined"]))
    spark.createDataFrame([(batch, result.files, result.rows, result.rejects)], DONE).coalesce(1).write.mode("append").parquet(f"{ledger}/done")
    if archive:
        _archive(spark, read, f"{archive.rstrip('/')}/{batch}")
    return result


def _archive(spark: SparkSession, read: dict[str, list[str]], folder: str) -> None:
    target, fs = T._file_system(spark, folder)
    fs.mkdirs(target)
    for kind, paths in read.items():
        for i, name in enumerate(paths):
            path, _ = T._file_system(spark, name)
            fs.rename(path, T._file_system(spark, f"{folder}/{kind}-{i:06d}-{path.getName()}")[0])


def ingest_new_files(
    spark: SparkSession,
    prefix: str,
    table: str,
    ledger: str,
    *,
    max_files: int = MAX_FILES,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
    **options,
) -> list[BatchResult]:
    """Finish open batches, then ingest all files under ``prefix`` that no batch holds yet. ``options`` go to
    ``run_batch``."""
    if "." in table:
        T.create_database(spark, table.rsplit(".", 1)[0])
    globs = {parse_ops.FORMAT_ACCESS: access_glob, parse_ops.FORMAT_JSON: json_glob}
    done = [run_batch(spark, batch, table, ledger, **options) for batch in open_batches(spark, ledger)]
    while batch := plan_batch(spark, prefix, globs, ledger, max_files):
        done.append(run_batch(spark, batch, table, ledger, **options))
    return done
