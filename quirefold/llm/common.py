"""What the corpus operators share: table access, shared scratch storage, distributed ranks and prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of characters that are neither space nor tab, LF, VT, FF, CR.
BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary folder stands in where the setting is missing and the session runs on this machine alone, as in tests;
    on a cluster a missing setting is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quirefold-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_PATH = "_quirefold_path"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more; other tables are left alone."""
    path = getattr(df, _PATH, None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def replaced(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """df, stored; then old, which df was worked out from and nothing else reads, is deleted."""
    out = store(df, name)
    discard(old)
    return out


def in_place(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows with _pl_row and _pl_part, written in buckets by _pl_part, the task that makes a row.

    A task's rows share one bucket, so that nothing is shuffled to write them, nor when a table of finds is joined by
    `found_for`: only the finds travel. Rows need no identity of their own. tasks: how many make the rows. The session is told that a bucket column
    among the keys of a join is enough to find both sides together.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"quirefold_{uuid.uuid4().hex}"
    tasks = tasks or max(1, rows.rdd.getNumPartitions())
    buckets = max(2 * tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("_pl_row", F.monotonically_increasing_id()).withColumn("_pl_part", part_of(F.col("_pl_row")))
    placed.write.bucketBy(buckets, "_pl_part").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def part_of(row: Column) -> Column:
    """The task's number in a monotonically increasing id."""
    return F.shiftright(row, 33).cast("int")


def found_for(placed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """placed (by `in_place`) joined with found (row and more); found is dealt to the buckets and hashed there."""
    keyed = found.withColumn("_pl_part", part_of(F.col("row"))).withColumnRenamed("row", "_pl_row").hint("shuffle_hash")
    return placed.join(keyed, ["_pl_part", "_pl_row"], how)


Batches = Iterator[pa.RecordBatch]
#: Rows of a batch that are Python objects at once.
SLICE = 256


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving the memory that it has freed back to the machine at its end: workers live on for later stages."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # no such call in other C libraries
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(column: pa.Array) -> Iterator[list]:
    """The bytes of a text column, SLICE rows at a time; the column itself isn't copied."""
    raw = column.cast(pa.binary())
    for i in range(0, len(raw), SLICE):
        yield raw.slice(i, SLICE).to_pylist()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the 1-based global position in the given total order, without a one-task sort.

    Rows are range-partitioned, counted by partition, and numbered inside their partition; only one count for each
    partition is gathered.
    """
    parts = store(df.repartitionByRange(*order).withColumn("_rk_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_rk_part").agg(F.count("*").alias("_rk_n")).select("_rk_part", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_before"))
    inside = F.row_number().over(Window.partitionBy("_rk_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_rk_part").withColumn(name, inside + F.col("_rk_before")).drop("_rk_part", "_rk_before")
