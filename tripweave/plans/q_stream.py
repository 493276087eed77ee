"""Queries: streaming statistics and alerts, run as streams over files of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..session import scratch_path
from ..streaming import alerts, monitor, run, stats, waits
from ..streaming.store import add_up
from . import sqltext as S
from .registry import query


PARTS, FILE_ROWS = 3, 200_000
# Every 7th event arrives 5 minutes late, within the watermark; with ``late``, every 211th 8 days late, far behind it.
_US = "unix_micros(timestamp)"


def _stream(spark, d, late=False, close=False):
    """Ride events in PARTS parts, one per trigger, by time of arrival.

    A part is a file, or equally many files for each once all parts are so large that every file gets rows.
    ``close`` adds a last part with one event a day after all others, so that the watermark closes every minute before it.
    """
    path = scratch_path(spark, "rides")
    rides = views.ride_events(spark, d)
    lo, hi = rides.agg(F.min(F.expr(_US)), F.max(F.expr(_US))).first()
    delay = f"CASE WHEN {'event_id % 211 = 5' if late else 'FALSE'} THEN {8 * 86_400_000_000} WHEN event_id % 7 = 0 THEN {300_000_000} ELSE 0 END"
    part = F.expr(f"least({PARTS - 1}, ({_US} + {delay} - {lo}L) * {PARTS} div ({hi - lo + 1}L))")
    sizes = {r["k"]: r["n"] for r in rides.groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect()}
    files = max(min(sizes.get(k, 0) for k in range(PARTS)) // FILE_ROWS, 1)
    for k in range(PARTS):
        some = rides.where(part == k)
        (some.coalesce(1) if files == 1 else some.repartition(files)).write.mode("append").parquet(path)
    if close:
        rides.orderBy(F.desc("timestamp")).limit(1).withColumns(
            {"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 DAY"), "pickup_area": F.lit("~"), "wait_time": F.lit(1.0)}).coalesce(1).write.mode("append").parquet(path)
    return run.read_rides(spark, path, files_per_trigger=files)


_LIMITS = {"high_demand": (1.0, "above"), "high_wait_time": (5.0, "above"), "low_vehicle_availability": (0.3, "below")}


def _total_rule(st):
    return st.where("total_orders > 100").select(
        F.lit("custom").alias("type"), F.lit("total_orders").alias("metric"), F.col("total_orders").alias("value"),
        F.lit(100.0).alias("threshold"), "as_of", F.lit("medium").alias("severity"))


def _monitor(spark, d, **kw):
    kw = {"surge_per_minute": 0.1, "demand_limit": 1, "wait_limit": 5, "thresholds": _LIMITS} | kw
    return monitor.RideMonitor(spark, **kw).run(_stream(spark, d, late=True))


# The events by part of arrival, without those whose minute was closed 10 minutes before the newest event of the parts before.
_KEPT = S.with_views("trips") + f""",
ends AS (SELECT min(epoch_us(datetime)) AS lo, max(epoch_us(datetime)) AS hi FROM trips),
arrived AS (SELECT trips.*, least({PARTS - 1}, ((epoch_us(datetime) + CASE WHEN event_id % 211 = 5 THEN {8 * 86_400_000_000} WHEN event_id % 7 = 0 THEN 300000000 ELSE 0 END - lo)
  * {PARTS}) // (hi - lo + 1)) AS part FROM trips, ends),
newest AS (SELECT part, max(m) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT part, max(datetime) AS m FROM arrived GROUP BY part)),
marked AS (SELECT a.*, coalesce(date_trunc('minute', datetime) + INTERVAL 11 MINUTE <= seen, false) AS late FROM arrived a JOIN newest USING (part)),
kept AS (SELECT *, date_trunc('minute', datetime) AS minute FROM marked WHERE NOT late)"""
_BUF = _KEPT + """,
nw AS (SELECT max(datetime) AS m, date_trunc('minute', max(datetime)) AS mm FROM kept), pane AS (SELECT kept.* FROM kept, nw WHERE minute > mm - INTERVAL 24 HOUR),
ew AS (SELECT round(list_reduce(list(wait_time ORDER BY datetime, event_id), lambda e, x: 0.1::DOUBLE * x + 0.9::DOUBLE * e), 6) AS e FROM kept WHERE wait_time > 0),
st AS (SELECT m AS as_of, least((SELECT count(*) FROM kept), 1000) AS buffered, (SELECT count(*) FROM kept) AS total_orders,
  (SELECT count(*) FROM kept WHERE hour(datetime) IN (7, 8, 9, 17, 18, 19)) AS peak_hour_orders, (SELECT count(*) FROM marked WHERE late) AS late_orders,
  count(*) FILTER (date_trunc('hour', datetime) = date_trunc('hour', m)) AS current_hour_orders, (SELECT e FROM ew) AS avg_wait_time,
  count(DISTINCT vehicle_id) FILTER (minute > mm - INTERVAL 30 MINUTE) AS active_vehicles, count(*) FILTER (minute > mm - INTERVAL 10 MINUTE) AS recent_10,
  count(*) FILTER (minute > mm - INTERVAL 30 MINUTE) AS recent_30, (count(*) FILTER (minute > mm - INTERVAL 30 MINUTE) / 30.0 > 0.1)::INT AS demand_surge,
  round(count(DISTINCT vehicle_id) FILTER (minute > mm - INTERVAL 30 MINUTE)::DOUBLE / count(DISTINCT vehicle_id), 6) AS low_vehicle_availability FROM pane, nw GROUP BY m, mm)
"""


@query("stream_source", S.T + "SELECT pickup_area, count(*) AS n, sum(vehicle_id)::BIGINT AS vehicle_sum FROM trips GROUP BY 1")
def stream_source(spark, d):
    out = run.micro_batches(_stream(spark, d), [], scratch_path(spark, "ingest"))
    return out.groupBy("pickup_area").agg(F.count("*").alias("n"), F.sum("vehicle_id").alias("vehicle_sum"))


@query("stream_last_n", _BUF + "SELECT event_id, datetime AS ts, vehicle_id, pickup_area FROM kept ORDER BY datetime DESC, event_id DESC LIMIT 1000")
def stream_last_n(spark, d):
    return _monitor(spark, d).table("buffer").select("event_id", "ts", "vehicle_id", "pickup_area")


@query("stream_total_orders", "SELECT count(*) AS total_orders FROM events")
def stream_total_orders(spark, d):
    return run.run_updates(stats.total_orders(_stream(spark, d)), [])


@query("stream_hour_orders", S.T + "SELECT date_trunc('hour', datetime) AS hour_start, count(*) AS orders FROM trips GROUP BY 1")
def stream_hour_orders(spark, d):
    return stats.ntz(run.run_updates(stats.hour_orders(_stream(spark, d)), ["hour_start"]), "hour_start")


@query("stream_peak_orders", S.T + f"SELECT count(*) AS peak_hour_orders FROM trips WHERE {S.PEAK}")
def stream_peak_orders(spark, d):
    return run.run_updates(stats.peak_orders(_stream(spark, d)), [])


@query("stream_avg_wait", _KEPT + """ SELECT pickup_area, count(*) FILTER (NOT late) AS n, (SELECT count(*) FROM marked WHERE late AND wait_time > 0) AS late_rows,
  round(list_reduce(list(wait_time ORDER BY datetime, event_id) FILTER (NOT late), lambda e, x: 0.1::DOUBLE * x + 0.9::DOUBLE * e), 6) AS avg_wait
  FROM marked WHERE wait_time > 0 GROUP BY 1""")
def stream_avg_wait(spark, d):
    found, dropped = waits.run_waits(_stream(spark, d, late=True, close=True))
    late = found.agg(F.sum("late")).first()[0] + dropped
    return found.select("pickup_area", "n", F.lit(late).cast("long").alias("late_rows"), F.round("avg_wait", 6).alias("avg_wait"))


_VEHICLES = S.T + """SELECT time_bucket(INTERVAL 30 MINUTE, datetime) AS window_start, count(DISTINCT vehicle_id) AS active_vehicles
  FROM trips GROUP BY 1"""


@query("stream_active_vehicles", _VEHICLES)
def stream_active_vehicles(spark, d):
    out = run.run_merged(stats.first_sightings(_stream(spark, d)), add_up("window_start"))
    return stats.ntz(out, "window_start")


@query("active_vehicles_table", _VEHICLES)
def active_vehicles_table(spark, d):
    return stats.ntz(stats.active_vehicles(views.ride_events(spark, d)), "window_start")


@query("stream_active_vehicles_approx")
def stream_active_vehicles_approx(spark, d):
    return stats.ntz(run.run_updates(stats.active_vehicles(_stream(spark, d), exact=False), ["window_start"]), "window_start")


@query("demand_surge", S.T + """SELECT window_start, count(*) AS n, round(count(*) / 30.0::DOUBLE, 6) AS per_minute FROM (
  SELECT date_trunc('minute', datetime) - to_minutes(i) AS window_start FROM trips, range(30) t(i)) GROUP BY 1 HAVING count(*) / 30.0 > 0.4""")
def demand_surge(spark, d):
    rates = run.run_updates(stats.window_rates(_stream(spark, d)), ["window_start"])
    return stats.ntz(stats.demand_surge(rates, 0.4), "window_start")


@query("stream_hotspots", _BUF + "SELECT pickup_area, count(*) AS n FROM pane GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def stream_hotspots(spark, d):
    return _monitor(spark, d).table("hotspots")


@query("stream_forecast", _BUF + """,
m AS (SELECT minute, count(*) AS n FROM pane GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM m) AS k, (SELECT avg(n) FROM (SELECT n FROM m ORDER BY minute DESC LIMIT 5)) AS v)
SELECT s::INT AS step, round(CASE WHEN k >= 5 THEN v * (1 + 0.1::DOUBLE * s) ELSE 0 END, 6) AS prediction,
  CASE WHEN k >= 5 THEN 0.8::DOUBLE ELSE 0 END AS confidence, CASE WHEN k >= 5 THEN 'moving_average' ELSE 'insufficient_data' END AS method FROM a, range(5) t(s)""")
def stream_forecast(spark, d):
    return _monitor(spark, d).table("forecast")


@query("stream_anomalies", _BUF + """SELECT 'high_demand' AS type, 'recent_10' AS metric, recent_10::DOUBLE AS value, 1::DOUBLE AS threshold, as_of,
  CASE WHEN recent_10 > 2 THEN 'high' ELSE 'medium' END AS severity FROM st WHERE recent_10 > 1
  UNION ALL SELECT 'high_wait_time', 'avg_wait_time', avg_wait_time, 5, as_of, 'high' FROM st WHERE avg_wait_time > 5
  UNION ALL SELECT 'demand_surge', 'recent_30', recent_30, NULL, as_of, 'high' FROM st WHERE demand_surge = 1""")
def stream_anomalies(spark, d):
    return _monitor(spark, d).table("anomalies")


_ALERTS = """SELECT 'threshold_exceeded' AS type, 'high_demand' AS metric, recent_10::DOUBLE AS value, 1::DOUBLE AS threshold, as_of,
  CASE WHEN recent_10 > 1.5 THEN 'high' ELSE 'medium' END AS severity FROM st WHERE recent_10 > 1
  UNION ALL SELECT 'threshold_exceeded', 'high_wait_time', avg_wait_time, 5, as_of, CASE WHEN avg_wait_time > 7.5 THEN 'high' ELSE 'medium' END FROM st WHERE avg_wait_time > 5
  UNION ALL SELECT 'threshold_exceeded', 'low_vehicle_availability', low_vehicle_availability, 0.3, as_of,
    CASE WHEN low_vehicle_availability < 0.2 THEN 'high' ELSE 'medium' END FROM st WHERE low_vehicle_availability < 0.3"""


@query("threshold_alerts", _BUF + _ALERTS)
def threshold_alerts(spark, d):
    return _monitor(spark, d).table("alerts")


@query("custom_rules", _BUF + _ALERTS + """ UNION ALL SELECT 'custom', 'total_orders', total_orders, 100, as_of, 'medium' FROM st WHERE total_orders > 100""")
def custom_rules(spark, d):
    return _monitor(spark, d, rules=[_total_rule]).table("alerts")


@query("alert_retention", S.with_views("trips") + """,
a AS (SELECT date_trunc('hour', datetime) AS as_of, count(*)::DOUBLE AS value FROM trips GROUP BY 1 HAVING count(*) > 15)
SELECT 'threshold_exceeded' AS type, 'high_demand' AS metric, value, 15::DOUBLE AS threshold, as_of, CASE WHEN value > 22.5 THEN 'high' ELSE 'medium' END AS severity
FROM a WHERE as_of > (SELECT max(as_of) FROM a) - INTERVAL 24 HOUR""")
def alert_retention(spark, d):
    hours = stats.hour_orders(views.ride_events(spark, d)).select(
        F.col("hour_start").cast("timestamp_ntz").alias("as_of"), F.col("orders").alias("high_demand"))
    return alerts.active_alerts(alerts.threshold_alerts(hours, {"high_demand": (15.0, "above")}))


@query("micro_batch", S.T + "SELECT event_id, pickup_area, wait_time, wait_time > 12 AS is_long FROM trips WHERE wait_time > 5")
def micro_batch(spark, d):
    steps = [lambda df: df.where("wait_time > 5"), lambda df: df.withColumn("is_long", F.col("wait_time") > 12),
             lambda df: df.select("event_id", "pickup_area", "wait_time", "is_long")]
    return run.micro_batches(_stream(spark, d), steps, scratch_path(spark, "micro"))


@query("stream_stats", _BUF + "SELECT *, recent_10 AS high_demand, avg_wait_time AS high_wait_time FROM st")
def stream_stats(spark, d):
    return _monitor(spark, d).table("stats")
