"""Stream sources and the ways results leave a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..schema import RIDE_EVENT
from ..session import scratch_path
from .store import Merge, Store, add, keep_last

WATERMARK = "10 minutes"


def read_rides(spark: SparkSession, folder: str, files_per_trigger: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Ride events from a folder of parquet files, with an event-time watermark."""
    rd = spark.readStream.schema(RIDE_EVENT)
    if files_per_trigger:
        rd = rd.option("maxFilesPerTrigger", files_per_trigger)
    return rd.parquet(folder).withWatermark("timestamp", watermark)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None,
                mode: str = "append") -> int:
    """Process what is available, one ``foreachBatch`` call per micro-batch, then stop.

    With the same checkpoint a later call goes on where the last one ended.  Returns the rows that stateful operators
    dropped because they came after the watermark.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "checkpoint")
    q = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)


def run_merged(stream: DataFrame, merge: Merge, checkpoint: str | None = None, out: str | None = None, mode: str = "append",
               every: int = 16) -> DataFrame:
    """Merge every micro-batch into a table that is kept as a base and a few deltas, and return the table.

    ``checkpoint`` and ``out`` belong together: with both of an earlier run the table goes on from there.
    """
    store = Store(stream.sparkSession, out or scratch_path(stream.sparkSession, "updates"), {"rows": merge}, every)
    run_batches(stream, lambda df, k: add(store, k, {"rows": df}), checkpoint, mode)
    if store.version is None:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return store.table("rows").select(*stream.columns)


def run_updates(agg: DataFrame, keys: Sequence[str], checkpoint: str | None = None, out: str | None = None, every: int = 16) -> DataFrame:
    """Run a streaming aggregate in update mode and return the last state of every key."""
    return run_merged(agg, keep_last(*keys), checkpoint, out, "update", every)


def chain(processors: Sequence[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """User functions applied one after the other."""
    return lambda df: reduce(lambda d, fn: d.transform(fn), processors, df)


def micro_batches(stream: DataFrame, processors: Sequence[Callable[[DataFrame], DataFrame]], out: str,
                  checkpoint: str | None = None) -> DataFrame:
    """Run the chain on every micro-batch and keep its result in a table.

    A batch replaces its own folder, so one that is repeated counts once.
    """
    run = chain(processors)

    def handle(df: DataFrame, batch_id: int) -> None:
        run(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(stream, handle, checkpoint)
    return stream.sparkSession.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
