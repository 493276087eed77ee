"""Queries: spatial, business and statistical features, windows, joins, sets, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import calendar as cal
from ..functions.geo import haversine_km
from ..functions.numbers import r_mean
from ..operators import common, explore, features, neighbours, series
from ..schema import CENTER_LAT, CENTER_LON
from ..session import materialize
from ..sources import files
from . import sqltext as S
from .q_basic import raw_copy
from .registry import query

_LAGS = (1, 2, 3, 6, 12, 24)
_WINS = (3, 6, 12, 24)


@query("density_features", S.with_views("trips") + """,
p AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM trips GROUP BY 1, 2),
c AS (SELECT a.y, a.x,
        sum(b.n) FILTER (sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) < 0.01::DOUBLE) - 1 AS d1,
        sum(b.n) FILTER (sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) < 0.05::DOUBLE) - 1 AS d5
      FROM p a JOIN p b ON b.y BETWEEN a.y - 0.06 AND a.y + 0.06 AND b.x BETWEEN a.x - 0.06 AND a.x + 0.06 GROUP BY 1, 2)
SELECT t.event_id, c.d1::BIGINT AS density_1km, c.d5::BIGINT AS density_5km
FROM trips t JOIN c ON t.latitude = c.y AND t.longitude = c.x""")
def density_features(spark, d):
    t = views.trips(spark, d).select("event_id", "latitude", "longitude")
    return neighbours.density_features(t, {"density_1km": 0.01, "density_5km": 0.05}).drop("latitude", "longitude")


@query("base_order_count", S.D + """SELECT event_id, base_station, CASE WHEN base_station IS NULL THEN NULL
  ELSE count(*) OVER (PARTITION BY base_station) END AS base_order_count FROM dirty""")
def base_order_count(spark, d):
    return features.base_order_count(views.dirty_trips(spark, d).select("event_id", "base_station"))


@query("label_encode", S.T + """SELECT event_id, pickup_area,
  (dense_rank() OVER (ORDER BY pickup_area) - 1)::INT AS pickup_area_encoded FROM trips""")
def label_encode(spark, d):
    return features.label_encode(views.trips(spark, d).select("event_id", "pickup_area"), "pickup_area")


@query("demand_forecast_hist", S.T + """SELECT event_id,
  count(*) OVER (PARTITION BY hour(datetime), isodow(datetime)) AS demand_forecast FROM trips""")
def demand_forecast_hist(spark, d):
    return features.demand_history(views.trips(spark, d).select("event_id", "datetime")).drop("datetime")


_DIST = ("(2 * 6371 * asin(sqrt(pow(sin(radians(40.7128 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.7128)) "
         "* pow(sin(radians(-74.0060 - longitude) / 2), 2))))")


@query("interaction_features", S.T + f"""SELECT event_id, {S.HR} * (isodow(datetime) > 5)::INT AS hour_weekend_interaction,
  round({_DIST} * ({S.PEAK})::INT, 6) AS distance_peak_interaction, {S.HR} * {S.HR} AS hour_squared,
  {S.HR} * {S.HR} * {S.HR} AS hour_cubed, round({_DIST} * {_DIST}, 6) AS distance_squared FROM trips""")
def interaction_features(spark, d):
    flags = cal.day_part_flags("datetime")
    t = views.trips(spark, d).select(
        "event_id", F.hour("datetime").alias("hour"), flags["is_weekend"].alias("is_weekend"),
        flags["is_peak_hour"].alias("is_peak_hour"),
        haversine_km(F.col("latitude"), F.col("longitude"), F.lit(CENTER_LAT), F.lit(CENTER_LON)).alias("distance_to_center"))
    out = features.interactions(t).drop("hour", "is_weekend", "is_peak_hour", "distance_to_center")
    return features.rounded(out)


def _grp_sql(key, expr, prefix):
    return S.T + f"""SELECT event_id, {key}, round(m1, 6) AS {prefix}_lat_mean, round(s1, 6) AS {prefix}_lat_std,
  round(m2, 6) AS {prefix}_lon_mean, round(s2, 6) AS {prefix}_lon_std, n AS {prefix}_order_count
FROM (SELECT event_id, {expr} AS {key} FROM trips) JOIN (SELECT {expr} AS {key}, avg(latitude) m1, stddev_samp(latitude) s1,
  avg(longitude) m2, stddev_samp(longitude) s2, count(*) n FROM trips GROUP BY 1) USING ({key})"""


@query("stats_by_hour", _grp_sql("hour", S.HR, "hour"))
def stats_by_hour(spark, d):
    t = views.trips(spark, d).withColumn("hour", F.hour("datetime"))
    return features.rounded(features.stats_by_hour(t).select(
        "event_id", "hour", "hour_lat_mean", "hour_lat_std", "hour_lon_mean", "hour_lon_std", "hour_order_count"))


@query("stats_by_base", _grp_sql("base_station", "base_station", "base"))
def stats_by_base(spark, d):
    return features.rounded(features.stats_by_base(views.trips(spark, d)).select(
        "event_id", "base_station", "base_lat_mean", "base_lat_std", "base_lon_mean", "base_lon_std", "base_order_count"))


@query("feature_summary", S.D + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS column_class, count(*) - count({c}) AS missing FROM dirty"
    for c, k in zip(views.TRIP_COLUMNS, ["numeric", "other", "numeric", "numeric", "text", "numeric", "text", "numeric", "numeric"])))
def feature_summary(spark, d):
    return features.feature_summary(views.dirty_trips(spark, d))


@query("features_all_steps")
def features_all_steps(spark, d):
    return features.all_features(views.trips(spark, d))


# ---- windows -----------------------------------------------------------------------


@query("hourly_spine", S.BH + "SELECT base_station, hour, demand FROM base_hourly")
def hourly_spine(spark, d):
    return series.hourly_counts(views.trips(spark, d), ["base_station"])


@query("hourly_spine_sparse", S.with_views("trips") + """,
c AS (SELECT vehicle_id, date_trunc('hour', datetime) AS hour, count(*) AS n FROM trips GROUP BY 1, 2)
SELECT s.vehicle_id, s.hour, coalesce(c.n, 0) AS demand
FROM (SELECT vehicle_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM c GROUP BY 1) s
LEFT JOIN c ON s.vehicle_id = c.vehicle_id AND s.hour = c.hour""")
def hourly_spine_sparse(spark, d):
    return series.hourly_counts(views.trips(spark, d), ["vehicle_id"])


@query("lag_features", S.with_views("hourly") + f""",
l AS (SELECT hour, demand, {', '.join(f'lag(demand, {k}) OVER (ORDER BY hour) AS order_count_lag_{k}' for k in _LAGS)} FROM hourly)
SELECT t.event_id, l.demand AS order_count, {', '.join(f'order_count_lag_{k}' for k in _LAGS)}
FROM trips t LEFT JOIN l ON date_trunc('hour', t.datetime) = l.hour""")
def lag_features(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime")
    return features.lag_features(t).drop("datetime", "hour_start")


def _roll_cols():
    out = []
    for n in _WINS:
        w = f"OVER (ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out += [f"round(avg(demand) {w}, 6) AS order_count_rolling_mean_{n}",
                f"round(stddev_samp(demand) {w}, 6) AS order_count_rolling_std_{n}",
                f"max(demand) {w} AS order_count_rolling_max_{n}", f"min(demand) {w} AS order_count_rolling_min_{n}"]
    return ", ".join(out)


@query("rolling_features", S.with_views("hourly") + f""",
l AS (SELECT hour AS h, demand, {_roll_cols()} FROM hourly)
SELECT t.event_id, l.* EXCLUDE (h, demand), l.demand AS order_count FROM trips t LEFT JOIN l ON date_trunc('hour', t.datetime) = l.h""")
def rolling_features(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime")
    return features.rounded(features.rolling_features(t).drop("datetime", "hour_start"))


@query("resample_ffill", S.with_views("trips") + """,
m AS (SELECT vehicle_id, date_trunc('hour', datetime) AS hour, avg(value) AS y FROM trips GROUP BY 1, 2),
g AS (SELECT vehicle_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM m GROUP BY 1)
SELECT g.vehicle_id, g.hour, round(m.y + 3e-9, 6) AS y FROM g ASOF JOIN m ON g.vehicle_id = m.vehicle_id AND g.hour >= m.hour""")
def resample_ffill(spark, d):
    h = series.hourly_mean_ffill(views.trips(spark, d), "value", ["vehicle_id"])
    return h.select("vehicle_id", "hour", r_mean(F.col("y")).alias("y"))


@query("moving_average_5", S.T + """SELECT base_station, minute, orders, round(avg(orders) OVER (
    PARTITION BY base_station ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg
  FROM (SELECT base_station, date_trunc('minute', datetime) AS minute, count(*) AS orders FROM trips GROUP BY 1, 2)""")
def moving_average_5(spark, d):
    return features.rounded(series.moving_average(views.trips(spark, d), 5, ["base_station"]))


_EWMA = """round(list_reduce(list(wait_time ORDER BY datetime, event_id), lambda e, x: 0.1::DOUBLE * x + 0.9::DOUBLE * e), 6)"""


@query("ewma_wait", S.T + f"""SELECT pickup_area, count(*) AS n, {_EWMA} AS ewma FROM trips WHERE wait_time > 0 GROUP BY 1
  UNION ALL SELECT 'all', count(*), {_EWMA} FROM trips WHERE wait_time > 0""")
def ewma_wait(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "pickup_area", "wait_time")
    per = series.ewma_final(t, "wait_time", ["pickup_area"], ["datetime", "event_id"])
    total = series.ewma_final(t, "wait_time", [], ["datetime", "event_id"]).select(F.lit("all").alias("pickup_area"), "n", "ewma")
    return features.rounded(per.unionByName(total))


@query("cumulative_count", S.T + """SELECT date, n, (sum(n) OVER (ORDER BY date))::BIGINT AS cumulative
  FROM (SELECT datetime::DATE AS date, count(*) AS n FROM trips GROUP BY 1)""")
def cumulative_count(spark, d):
    return series.cumulative_days(views.trips(spark, d))


@query("diff_direction", S.BH + """SELECT base_station, hour, demand, diff, sign(diff)::INT AS direction FROM (
  SELECT *, demand - lag(demand) OVER (PARTITION BY base_station ORDER BY hour) AS diff FROM base_hourly)""")
def diff_direction(spark, d):
    h = series.hourly_counts(views.trips(spark, d), ["base_station"])
    return series.differences(h, "demand", keys=["base_station"]).withColumn("direction", F.signum("diff").cast("int"))


# ---- joins, sets, sorts ---------------------------------------------------------------


@query("join_inner_hourly", S.with_views("dirty") + """,
a AS (SELECT date_trunc('hour', datetime) AS hour_date, count(*) AS demand FROM dirty GROUP BY 1),
b AS (SELECT date_trunc('hour', datetime) AS hour_date, avg(latitude) AS lat, avg(longitude) AS lon FROM dirty GROUP BY 1)
SELECT a.hour_date, demand, round(lat + 3e-9, 6) AS lat_mean, round(lon + 3e-9, 6) AS lon_mean FROM a JOIN b USING (hour_date)""")
def join_inner_hourly(spark, d):
    # both sides group the same rows by the same key, so one aggregate replaces the join
    return views.dirty_trips(spark, d).groupBy(cal.hour_start("datetime").alias("hour_date")).agg(
        F.count("*").alias("demand"), r_mean(F.avg("latitude")).alias("lat_mean"), r_mean(F.avg("longitude")).alias("lon_mean"))


@query("join_left_stats", S.D + """SELECT event_id, base_station, round(m, 6) AS base_value_mean FROM dirty
  LEFT JOIN (SELECT base_station AS b, avg(value) AS m FROM dirty GROUP BY 1) ON base_station = b""")
def join_left_stats(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "base_station", "value")
    m = t.where("base_station is not null").groupBy("base_station").agg(F.avg("value").alias("base_value_mean"))
    return features.rounded(common.attach(t, m, ["base_station"]).drop("value"))


@query("join_left_hour", S.with_views("hourly") + """ SELECT event_id, demand AS hour_demand FROM trips
  LEFT JOIN (SELECT * FROM hourly WHERE demand > 10) ON date_trunc('hour', datetime) = hour""")
def join_left_hour(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime").withColumn("hour", cal.hour_start("datetime"))
    busy = series.hourly_counts(t.select("datetime")).where("demand > 10").withColumnRenamed("demand", "hour_demand")
    return common.attach(t, busy, ["hour"]).select("event_id", "hour_demand")


@query("join_lookup", S.T + """SELECT t.event_id, coalesce(n, 0) AS known FROM trips t LEFT JOIN (
    SELECT hour(datetime) AS h, isodow(datetime) AS w, count(*) AS n FROM trips GROUP BY 1, 2
    HAVING avg(wait_time) > 10) ON hour(t.datetime) = h AND isodow(t.datetime) = w""")
def join_lookup(spark, d):
    t = views.trips(spark, d).withColumns({"h": F.hour("datetime"), "w": F.weekday("datetime")})
    table = t.groupBy("h", "w").agg(F.count("*").alias("known"), F.avg("wait_time").alias("a")).where("a > 10").drop("a")
    # at most 24 x 7 rows
    return t.join(F.broadcast(table), ["h", "w"], "left").select(
        "event_id", F.coalesce("known", F.lit(0).cast("long")).alias("known"))


@query("join_semi_isin", S.T + """SELECT event_id, pickup_area FROM trips WHERE pickup_area IN (
  SELECT pickup_area FROM trips GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""")
def join_semi_isin(spark, d):
    t = views.trips(spark, d).select("event_id", "pickup_area")
    top = t.groupBy("pickup_area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pickup_area").limit(5)
    return t.join(F.broadcast(top.select("pickup_area")), "pickup_area", "left_semi")


@query("join_range_radius", S.with_views("trips") + """,
a AS (SELECT DISTINCT latitude AS y, longitude AS x FROM trips),
b AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM trips GROUP BY 1, 2)
SELECT a.y AS latitude, a.x AS longitude, coalesce(sum(b.n), 0)::BIGINT AS hits
FROM a LEFT JOIN b ON sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) < 0.02::DOUBLE
  AND b.y BETWEEN a.y - 0.03 AND a.y + 0.03 GROUP BY 1, 2""")
def join_range_radius(spark, d):
    points = materialize(neighbours.distinct_points(views.trips(spark, d)), "points")
    return neighbours.radius_counts(points, points, 0.02).withColumnsRenamed({"y": "latitude", "x": "longitude"})


@query("union_all_files", S.T + """SELECT strftime(datetime, '%-m/%-d/%Y %-H:%M:%S') AS time_text, latitude AS lat,
  longitude AS lon, base_station AS base FROM trips""")
def union_all_files(spark, d):
    root = raw_copy(spark, d, "union-files")
    a, b = (files.read_trip_csv(spark, f"{root}/trips-raw-{x}.csv").drop("source_file") for x in "ab")
    both = a.unionByName(b.select("Base", "Lon", "Lat", "Date/Time"))
    return both.select(F.col("Date/Time").alias("time_text"), F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), F.col("Base").alias("base"))


@query("union_distinct", S.T + """SELECT base_station, vehicle_id, pickup_area FROM trips WHERE value > 50
  UNION SELECT base_station, vehicle_id, pickup_area FROM trips WHERE wait_time > 10""")
def union_distinct(spark, d):
    t = views.trips(spark, d)
    cols = ["base_station", "vehicle_id", "pickup_area"]
    return t.where("value > 50").select(*cols).union(t.where("wait_time > 10").select(*cols)).distinct()


@query("sort_time", S.T + "SELECT event_id, datetime FROM trips ORDER BY datetime, event_id")
def sort_time(spark, d):
    return views.trips(spark, d).select("event_id", "datetime").orderBy("datetime", "event_id")


@query("topk_values", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS v, count(*) AS n FROM customer GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)"
    for c in ("c_mktsegment", "c_name")))
def topk_values(spark, d):
    return common.top_values(views.table(spark, d, "customer"), ["c_mktsegment", "c_name"], 5).drop("rk")


@query("nlargest_hours", S.with_views("trips") + """,
h AS (SELECT hour(datetime)::INT AS k, count(*) AS n FROM trips GROUP BY 1),
w AS (SELECT (isodow(datetime) - 1)::INT AS k, count(*) AS n FROM trips GROUP BY 1)
SELECT * FROM (SELECT 'peak_hour' AS kind, k, n FROM h ORDER BY n DESC, k LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'off_peak_hour', k, n FROM h ORDER BY n, k LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'busiest_day', k, n FROM w ORDER BY n DESC, k LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'quietest_day', k, n FROM w ORDER BY n, k LIMIT 1)""")
def nlargest_hours(spark, d):
    return explore.peak_rows(explore.temporal_counts(views.trips(spark, d)))
