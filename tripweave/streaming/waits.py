"""Smoothed waiting times of a stream in the order of event time.

Rows wait in a table until the watermark has passed their minute; then they are ordered and folded into one stretch of the
smoothing per area (see ``series.ewma_parts``), and the stretches of all batches are chained.  The table holds the rows of the
watermark's delay alone, is written by tasks, and needs no keyed state: any state store of the session will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.series import chain_stretches, ewma_parts, ewma_value
from ..session import scratch_path
from .run import WATERMARK, run_batches
from .store import AT, REPLACE, Store, add_up

ORDER = ["timestamp", "event_id"]


class WaitFolder:
    """Handler for ``foreachBatch``: folds the minutes that the watermark closes, counts the rows of minutes closed before.

    Only waiting times above 0 count; rows without a time are left out.  A row of null area has an area of its own.
    """

    def __init__(self, spark: SparkSession, out: str, alpha: float = 0.1, delay: str = WATERMARK, every: int = 16):
        self.alpha, self.delay = alpha, F.expr(f"INTERVAL {delay}")
        self.store = Store(spark, out, {
            "rows": lambda rows: chain_stretches(rows, ["pickup_area"], AT, alpha),  # minutes ascend from batch to batch
            "late": add_up("pickup_area"), "held": REPLACE, "seen": add_up(largest=["seen"])}, every)

    def _closed(self, mark: Column) -> Column:
        """Whether the watermark, with ``mark`` as the newest time, has reached the end of the row's minute."""
        return F.coalesce(F.date_trunc("minute", "timestamp") + F.expr("INTERVAL 1 MINUTE") <= F.timestamp_micros(mark) - self.delay, F.lit(False))

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        batch = self.store.begin(batch_id)
        if batch is None:
            return  # repeated after its commit
        known = F.lit(None if batch.first else batch.table("seen").first()["seen"]).cast("long")
        df = df.where("timestamp IS NOT NULL").select(*ORDER, "pickup_area", "wait_time").persist()
        seen = df.agg(F.max(F.unix_micros("timestamp")).alias("seen"))
        now = F.greatest(F.lit(seen.first()["seen"]).cast("long"), known)
        rows, late = df.where("wait_time > 0"), self._closed(known)
        held = rows.where(~late)
        if not batch.first:
            held = held.unionByName(batch.table("held"))
        batch.write({
            "rows": ewma_parts(held.where(self._closed(now)), "wait_time", ["pickup_area"], ORDER, self.alpha),
            "late": rows.where(late).groupBy("pickup_area").agg(F.count("*").alias("late")),
            "held": held.where(~self._closed(now)), "seen": seen}).commit()
        df.unpersist()

    def table(self) -> DataFrame:
        """(pickup_area, n, avg_wait, late) of all closed minutes, as of the last batch."""
        late = self.store.table("late").withColumnsRenamed({"pickup_area": "_area"})
        both = self.store.table("rows").join(late, F.col("_area").eqNullSafe(F.col("pickup_area")), "full")
        none = F.lit(0).cast("long")
        return both.select(F.coalesce("pickup_area", "_area").alias("pickup_area"), F.coalesce("n", none).alias("n"),
                           ewma_value(self.alpha).alias("avg_wait"), F.coalesce("late", none).alias("late"))


def run_waits(stream: DataFrame, checkpoint: str | None = None, out: str | None = None, alpha: float = 0.1, every: int = 16,
              delay: str = WATERMARK) -> tuple[DataFrame, int]:
    """(pickup_area, n, avg_wait, late) of all closed minutes, and the late rows that Spark itself dropped.

    ``delay`` is that of the stream's watermark; ``checkpoint`` and ``out`` belong together.
    """
    folder = WaitFolder(stream.sparkSession, out or scratch_path(stream.sparkSession, "waits"), alpha, delay, every)
    dropped = run_batches(stream, folder, checkpoint)
    return folder.table(), dropped
