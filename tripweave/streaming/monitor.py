"""Running statistics of a ride stream, kept as panes that merge.

A batch adds one row per (minute, area) with its count, the last minute of each vehicle, its totals, and a stretch of the
smoothed waiting time; every figure is a merge of these, so no figure depends on a buffer of events.  Rows whose minute the
watermark has closed are dropped and counted.  Waiting times of open minutes are held back until they can be put in order.
The state is bounded by areas x minutes of the horizon, by vehicles, and by the rows of the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import hour_start, is_peak, minute_start
from ..operators.forecast import minutes_forecast
from ..operators.series import chain_stretches, ewma_parts, ewma_value
from ..session import materialize, scratch_path
from . import alerts as al
from .run import run_batches
from .store import AT, REPLACE, Batch, Store, add_up

ALPHA = 0.1
ORDER = ["ts", "event_id"]
HELD = ["ts", "event_id", "pickup_area", "wait_time"]
BUFFERED = ["ts", "event_id", "vehicle_id", "pickup_area", "wait_time"]


def _time(value) -> Column:
    return F.lit(None if value is None else value.isoformat()).cast("timestamp_ntz")


def _chain(rows: DataFrame) -> DataFrame:
    return chain_stretches(rows, ["every", "pickup_area"], AT, ALPHA)


class RideMonitor:
    """Handler for ``foreachBatch``; read results with ``table(name)``.

    ``out`` and the stream's checkpoint belong together: a monitor on the folder of an earlier one goes on from its last
    committed batch.  ``buffer`` is the number of events of the table ``buffer`` alone, ``horizon`` the hours that panes are kept.
    """

    def __init__(self, spark: SparkSession, out: str | None = None, buffer: int = 1000, surge_per_minute: float = 2.0,
                 demand_limit: float = 50, wait_limit: float = 10, thresholds=None, rules: Sequence[al.Rule] = (),
                 callbacks: dict[str, Sequence[Callable[[DataFrame], None]]] | None = None, delay: str = "10 minutes", horizon: int = 24,
                 every: int = 16):
        self.spark = spark
        self.out = out or scratch_path(spark, "monitor")
        self.buffer, self.surge, self.demand, self.wait = buffer, surge_per_minute, demand_limit, wait_limit
        self.delay, self.horizon = F.expr(f"INTERVAL {delay}"), F.expr(f"INTERVAL {int(horizon)} HOURS")
        self.thresholds = thresholds or al.THRESHOLDS
        self.rules = list(rules)
        self.callbacks = callbacks or {}
        fresh = lambda merge: lambda rows: self._fresh(merge(rows))
        self.store = Store(spark, self.out, {
            "panes": fresh(add_up("minute", "pickup_area")), "vehicles": fresh(add_up("vehicle_id", largest=["minute"])),
            "totals": add_up(largest=["seen"]), "waits": _chain, "held": REPLACE, "buffer": REPLACE, "alerts": REPLACE}, every)

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """Without the minutes that are older than the horizon; the newest one is in the same table."""
        return rows.where(F.col("minute") > rows.agg(F.max("minute") - self.horizon).scalar())

    @property
    def last(self) -> int | None:
        return self.store.version

    def table(self, name: str) -> DataFrame:
        """panes, vehicles, totals, buffer, alerts, waits, stats, hotspots, forecast, anomalies as of the last batch."""
        return self._view(self.store, name)

    def _view(self, state: Store | Batch, name: str) -> DataFrame:
        if name == "waits":
            # closed minutes from the chain, held rows after them
            parts = state.table("waits").withColumn("_o", F.lit(0)).unionByName(_both(state.table("held")).withColumn("_o", F.lit(1)))
            one = chain_stretches(parts, ["every", "pickup_area"], "_o", ALPHA)
            return one.select("every", "pickup_area", "n", ewma_value(ALPHA).alias("avg_wait"))
        if name == "stats":
            return statistics(state.table("panes"), state.table("vehicles"), state.table("totals"), self._view(state, "waits"), self.buffer, self.surge)
        if name == "hotspots":
            return hot_areas(state.table("panes"))
        if name == "forecast":
            return minutes_forecast(state.table("panes").groupBy("minute").agg(F.sum("n").alias("n")))
        if name == "anomalies":
            return al.anomaly_alerts(self._view(state, "stats"), self.demand, self.wait)
        return state.table(name)

    # ---- one micro-batch ------------------------------------------------------

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        batch = self.store.begin(batch_id)
        if batch is None:
            return  # repeated after its commit
        known = _time(None if batch.first else batch.table("totals").first()["seen"])
        rows = df.withColumn("ts", F.col("timestamp").cast("timestamp_ntz")).where("ts IS NOT NULL").withColumn("minute", minute_start("ts"))
        # a minute is closed once the watermark, as of the batches before, has reached its end
        closed = lambda mark: F.coalesce(minute_start("ts") + F.expr("INTERVAL 1 MINUTE") <= mark - self.delay, F.lit(False))
        rows = rows.withColumn("late", closed(known)).persist()
        good = rows.where("NOT late")
        found = rows.agg(F.count_if(~F.col("late")).alias("total_orders"), F.count_if(~F.col("late") & is_peak(F.hour("ts"))).alias("peak_hour_orders"),
                          F.count_if("late").alias("late_orders"), F.max(F.when(~F.col("late"), F.col("ts"))).alias("seen"))
        totals = found.first()
        now = F.greatest(_time(totals["seen"]), known)
        held, buffer = good.select(*HELD).where("wait_time > 0"), good.select(*BUFFERED)
        if not batch.first:
            held, buffer = held.unionByName(batch.table("held")), buffer.unionByName(batch.table("buffer"))
        batch.write({
            "panes": good.groupBy("minute", "pickup_area").agg(F.count("*").alias("n")),
            "vehicles": good.where("vehicle_id IS NOT NULL").groupBy("vehicle_id").agg(F.max("minute").alias("minute")),
            "totals": self.spark.createDataFrame([totals], found.schema).coalesce(1), "waits": _both(held.where(closed(now))), "held": held.where(~closed(now)),
            "buffer": buffer.orderBy(*[F.desc(c) for c in ORDER]).limit(self.buffer)})
        rows.unpersist()
        stats = materialize(self._view(batch, "stats"), "stats")
        found = al.threshold_alerts(stats, self.thresholds).unionByName(al.apply_rules(stats, self.rules))
        if not batch.first:
            found = found.unionByName(batch.table("alerts"))
        batch.write({"alerts": al.active_alerts(found, 24)}).commit()
        for event, name in (("stats_update", "stats"), ("prediction_update", "forecast"), ("anomaly_detected", "anomalies")):
            for fn in self.callbacks.get(event, ()):
                fn(stats if name == "stats" else self.table(name))

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> "RideMonitor":
        run_batches(stream, self, checkpoint)
        return self


def _both(rows: DataFrame) -> DataFrame:
    """Stretches per area (every = false) and of all rows (every = true, no area)."""
    sides = F.explode(F.array(F.struct(F.lit(False).alias("every"), F.col("pickup_area").alias("pickup_area")),
                              F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("pickup_area"))))
    return ewma_parts(rows.select(*ORDER, "wait_time", sides.alias("s")).select(*ORDER, "wait_time", "s.*"), "wait_time", ["every", "pickup_area"], ORDER, ALPHA)


def statistics(panes: DataFrame, vehicles: DataFrame, totals: DataFrame, waits: DataFrame, buffer: int, surge: float) -> DataFrame:
    """The row of running figures.  The last so many minutes are whole panes: that of the newest event and those before it."""
    now = totals.select("seen").scalar()

    def within(minutes: int) -> Column:
        return F.col("minute") > minute_start(now) - F.expr(f"INTERVAL {minutes} MINUTES")

    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    p = panes.agg(count(within(10)).alias("recent_10"), count(within(30)).alias("recent_30"),
                  count(hour_start("minute") == hour_start(now)).alias("current_hour_orders"))
    v = vehicles.agg(F.count_if(within(30)).alias("active_vehicles"), F.count("*").alias("vehicles"))
    one = totals.select(F.struct("*").alias("t")).scalar()
    car = v.select(F.struct("*").alias("v")).scalar()
    wait = F.round(waits.where("every").select("avg_wait").scalar(), 6)
    return p.select(
        one["seen"].alias("as_of"), F.least(one["total_orders"], F.lit(buffer)).alias("buffered"), one["total_orders"].alias("total_orders"),
        one["peak_hour_orders"].alias("peak_hour_orders"), one["late_orders"].alias("late_orders"), "current_hour_orders", wait.alias("avg_wait_time"),
        car["active_vehicles"].alias("active_vehicles"), "recent_10", "recent_30", (F.col("recent_30") / 30.0 > surge).cast("int").alias("demand_surge"),
        F.col("recent_10").alias("high_demand"), wait.alias("high_wait_time"),
        F.round(F.try_divide(car["active_vehicles"].cast("double"), car["vehicles"].cast("double")), 6).alias("low_vehicle_availability"))


def hot_areas(panes: DataFrame, k: int = 5) -> DataFrame:
    """The areas with most orders in the horizon, ties by name."""
    return (panes.where(F.col("pickup_area").isNotNull()).groupBy("pickup_area").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "pickup_area").limit(k))
