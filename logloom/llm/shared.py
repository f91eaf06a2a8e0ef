"""Shared tables and global orderings without a single-task step."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import shared_dir

#: Setting, Spark's own default, bound used here.
ARROW_BOUNDS = [
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
]

#: Spark's setting to delete the shuffle files of an action when it ends.
CLEAR_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written by ``stored`` in this process, for ``clean_up``.
_STORED: list[str] = []

TEST_FOLD = 0
FOLDS = 5


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that the functions that run in
    tasks can be imported there wherever the driver was started, and bound the Arrow batches (rows and
    bytes) that one Python worker holds, unless the session sets other bounds."""
    for key, usual, bound in ARROW_BOUNDS:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, bound)
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="logloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._logloom_shipped = True


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back: cuts the lineage,
    survives lost executors, and is computed once however often it is used. The shuffle files of the
    write go when it ends: what is read back needs none of them."""
    path = shared_dir(spark, "llm", name)
    _STORED.append(path)
    before = spark.conf.get(CLEAR_SHUFFLES, None)
    spark.conf.set(CLEAR_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAR_SHUFFLES)
        else:
            spark.conf.set(CLEAR_SHUFFLES, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_in = path
    return found


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete ``tables`` (as ``stored`` returned them), which nothing reads from now on."""
    for table in tables:
        _delete(spark, table._stored_in)
        _STORED.remove(table._stored_in)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this process. Call it when the results have been consumed: a
    DataFrame that was returned may still read these folders."""
    for folder in _STORED:
        _delete(spark, folder)
    _STORED.clear()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished counts and lists (those of ``stored`` go at
    once): it does so when the driver's garbage collector finds them unused, which an idle driver heap can put
    off for a whole job (see ``spark.cleaner.periodicGC.interval``). For jobs of many shuffles, between their steps."""
    spark._jvm.System.gc()


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out from every training."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_parts(spark: SparkSession, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored with its range number as ``part``. The
    ranges are drawn once: what is read back no longer depends on a sample."""
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    return stored(spark, ranged, name)


def next_and_previous(spark: SparkSession, ids: DataFrame, carried: str) -> DataFrame:
    """``ids`` (``doc_id``, ``carried``; one row per id) with ``next_id`` and the previous row's id
    and ``carried`` value in ascending ``doc_id`` order, cyclically.

    Windows run inside ranges of ids; only one row per range meets in the window over ranges.
    """
    parts = range_parts(spark, ids.select("doc_id", carried), ["doc_id"], "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    rows = parts.withColumns(
        {
            "next_id": F.lead("doc_id").over(inside),
            "previous_id": F.lag("doc_id").over(inside),
            "previous_value": F.lag(carried).over(inside),
        }
    )
    ends = parts.groupBy("part").agg(F.min("doc_id").alias("low"), F.max_by(F.struct("doc_id", carried), "doc_id").alias("high"))
    over = Window.orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select(
        "part",
        F.coalesce(F.lead("low").over(over), F.first("low").over(whole)).alias("next_low"),
        F.coalesce(F.lag("high").over(over), F.last("high").over(whole)).alias("previous_high"),
    )
    return rows.join(edges, "part").select(
        "doc_id",
        carried,
        F.coalesce("next_id", "next_low").alias("next_id"),
        F.coalesce("previous_id", F.col("previous_high.doc_id")).alias("previous_id"),
        F.coalesce("previous_value", F.col(f"previous_high.{carried}")).alias("previous_value"),
    )
