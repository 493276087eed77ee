"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tripweave", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where
    spark-submit and AQE coalescing decide them.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        b = (b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("TRIPWEAVE_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        root = tempfile.mkdtemp(prefix="tripweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/tripweave/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the
    optimizer the true size of the table, so that small ones are broadcast and
    large ones are not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 2_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition on ``keys`` (or evenly): shuffle partitions, at most two per core.

    Given as a number, the partitioning is not coalesced by size: a small table
    that is about to be expanded or scored keeps all tasks busy.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, 8))
    return df.repartition(n, *keys)


def spread_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``spread`` for a small table only; a large one has enough input splits and is not shuffled."""
    rows = df.count() if rows is None else rows
    return spread(df) if rows <= SMALL_ROWS else df


TASK_ROWS = 250_000


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as ``spread`` makes, and to more where one would get over TASK_ROWS rows.

    For tables that are scanned again and again or kept in memory: what a task reads does not grow with the table.
    """
    spark, n = df.sparkSession, -(-df.count() // TASK_ROWS)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, 8))
    return df.repartition(max(n, least))


def own_code(df: DataFrame) -> DataFrame:
    """``df`` as generated code of its own; rows and partitions stay where they are.

    Spark fuses the steps between two shuffles into one method, and the JVM interprets a method of over 8000 bytes for ever.
    Many computed columns are put in several steps by this: a coalesce to more partitions than there are keeps each one
    and ends the method.
    """
    return df.coalesce(1 << 20)


def small_side(table: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark a written table for broadcast when it is small, else for a shuffled hash join.

    The row count comes from the file footers.  Without the mark the optimizer
    may broadcast the other side, whose size it cannot foresee after an explode.
    """
    if table.count() <= max_rows:
        return F.broadcast(table)
    return table.hint("shuffle_hash")


def one_row(df: DataFrame) -> dict:
    """Fetch the single row of a global aggregate as a dict."""
    row = df.first()
    return row.asDict(recursive=True) if row is not None else {}


def in_parallel(fn: Callable, items: Iterable, threads: int = 4) -> list:
    """Run independent Spark jobs from a few driver threads; results in order."""
    items = list(items)
    if len(items) < 2:
        return [fn(x) for x in items]
    target = inheritable_thread_target(SparkSession.getActiveSession())(fn)
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(target, items)
