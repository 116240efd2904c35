"""Cutting lineage, and orders over a whole table without one task seeing all of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  A single machine gets one of its own; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if not there.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='snapgraph-')}")
        there = context._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Where rows hold cells of a megabyte and more, the writer looks at a page's size from the first row on; it would look at a row group's only after a hundred.
PAGES, GROUPS = "parquet.page.size.row.check.min", "parquet.block.row.count.limit"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that go to a Python worker at once, and where Spark is told.
BATCH_BYTES, BATCH_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows of large cells reach Python few at a time; a setting of the user's stays."""
    if spark.conf.get(BATCH_CONF) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def stored(df: DataFrame, group: int | None = None) -> tuple[DataFrame, str]:
    """The rows from a Parquet folder of their own in the shared folder, and its path, to be dropped by who knows when they are read.

    group: most rows that the writer holds, for rows of large cells.  The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**({PAGES: "1", GROUPS: str(group)} if group else {})).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(named, True)


def ordered_parts(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt to ranges of the order; _part numbers the ranges in that order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds each row's 0-based place in the order, in two passes: rows per range, then places inside each."""
    return scanned(df, order, {name: (F.lit(1), "sum")}, inclusive=False)


#: How partial results of a scan combine, and what an empty prefix gives.
FOLDS = {"sum": (F.sum, 0), "min": (F.min, None), "max": (F.max, None)}


def scanned(df: DataFrame, order, columns: dict[str, tuple[Column, str]], inclusive: bool = True) -> DataFrame:
    """Adds prefix folds over the whole table: {name: (value, sum | min | max)}.

    The fold of each range is a row of a small table; only that table is scanned by one task.
    """
    parts = ordered_parts(df, *order)
    totals = parts.groupBy("_part").agg(*(FOLDS[kind][0](value).alias(f"_{name}_of") for name, (value, kind) in columns.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_p"), *(FOLDS[kind][0](f"_{name}_of").over(before).alias(f"_{name}_before") for name, (_, kind) in columns.items()))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    # One row for each range: as many as there are shuffle partitions.
    joined = parts.join(F.broadcast(starts), parts["_part"] == starts["_p"])
    added = []
    for name, (value, kind) in columns.items():
        own, earlier = FOLDS[kind][0](value).over(inside), F.col(f"_{name}_before")
        if kind == "sum":
            both = F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            both = (F.least if kind == "min" else F.greatest)(own, earlier)
        added.append(both.alias(name))
    return joined.select(*df.columns, *added)
