"""Queries: spatial summaries, hotspots and the aggregates behind charts and maps."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import views
from ..operators import chartdata, cluster, spatial
from . import sqltext as S
from .registry import query


def _xy(spark, d):
    return views.trips(spark, d).select("event_id", "latitude", "longitude")


@query("geo_bounds", S.D + """SELECT round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
  round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max FROM dirty""")
def geo_bounds(spark, d):
    return spatial.bounds(views.dirty_trips(spark, d))


@query("geo_center", S.D + """SELECT round(avg(latitude) + 3e-9, 6) AS lat_mean, round(avg(longitude) + 3e-9, 6) AS lon_mean,
  round(median(latitude), 6) AS lat_median, round(median(longitude), 6) AS lon_median FROM dirty""")
def geo_center(spark, d):
    return spatial.center(views.dirty_trips(spark, d))


@query("geo_spread", S.D + """SELECT round(max(latitude) - min(latitude), 6) AS lat_range, round(max(longitude) - min(longitude), 6) AS lon_range,
  round(stddev_samp(latitude), 6) AS lat_std, round(stddev_samp(longitude), 6) AS lon_std FROM dirty""")
def geo_spread(spark, d):
    return spatial.spread_of(views.dirty_trips(spark, d))


@query("geo_density", S.with_views("trips") + """,
a AS (SELECT event_id, latitude, longitude FROM trips),
c AS (SELECT a.event_id, count(*) FILTER (sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude)) < 0.01::DOUBLE) - 1 AS h1,
    count(*) FILTER (sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude)) < 0.05::DOUBLE) - 1 AS h5
  FROM a, trips b GROUP BY 1)
SELECT '1km' AS radius, round(avg(h1), 6) AS mean, round(stddev_pop(h1), 6) AS std, max(h1) AS max FROM c
UNION ALL SELECT '5km', round(avg(h5), 6), round(stddev_pop(h5), 6), max(h5) FROM c""")
def geo_density(spark, d):
    return spatial.probe_density(_xy(spark, d), {"1km": 0.01, "5km": 0.05})


_GEO_OUT = """latitude < f.a1 - 1.5 * (f.b1 - f.a1) OR latitude > f.b1 + 1.5 * (f.b1 - f.a1)"""
_GEO_OUT2 = """longitude < f.a2 - 1.5 * (f.b2 - f.a2) OR longitude > f.b2 + 1.5 * (f.b2 - f.a2)"""


@query("geo_outliers", S.with_views("dirty") + f""",
w AS (SELECT event_id, latitude * CASE WHEN event_id % 101 = 0 THEN 1.05 ELSE 1 END AS latitude,
      longitude * CASE WHEN event_id % 211 = 0 THEN 1.05 ELSE 1 END AS longitude FROM dirty),
f AS (SELECT quantile_cont(latitude, 0.25) a1, quantile_cont(latitude, 0.75) b1, quantile_cont(longitude, 0.25) a2, quantile_cont(longitude, 0.75) b2 FROM w)
SELECT count(*) FILTER ({_GEO_OUT}) AS lat_outliers, count(*) FILTER ({_GEO_OUT2}) AS lon_outliers,
  (SELECT count(*) FROM (SELECT DISTINCT w.* FROM w, f WHERE ({_GEO_OUT}) OR ({_GEO_OUT2}))) AS total_outliers FROM w, f""")
def geo_outliers(spark, d):
    t = views.dirty_trips(spark, d).select(
        "event_id",
        (F.col("latitude") * F.when(F.col("event_id") % 101 == 0, 1.05).otherwise(1.0)).alias("latitude"),
        (F.col("longitude") * F.when(F.col("event_id") % 211 == 0, 1.05).otherwise(1.0)).alias("longitude"))
    return spatial.geo_outliers(t)


def _bin(v, lo, hi, n):
    return f"least(floor(round(({v} - {lo}) / ({hi} - {lo}) * {n}, 9)), {n - 1})::INT"


_RANGE = "SELECT min(latitude) y0, max(latitude) y1, min(longitude) x0, max(longitude) x1"


@query("hotspots", S.with_views("trips") + f""",
e AS ({_RANGE} FROM trips),
c AS (SELECT {_bin('latitude', 'y0', 'y1', 49)} AS iy, {_bin('longitude', 'x0', 'x1', 49)} AS ix, count(*) AS n FROM trips, e GROUP BY 1, 2),
h AS (SELECT * FROM c WHERE n >= (SELECT quantile_cont(n, 0.9) FROM c))
SELECT round(y0 + (iy + 0.5) * ((y1 - y0) / 49), 6) AS lat_center, round(x0 + (ix + 0.5) * ((x1 - x0) / 49), 6) AS lon_center, n AS density,
  (SELECT max(n) FROM c) AS max_density, round((SELECT sum(n) FROM c)::DOUBLE / 2401, 6) AS mean_density, (SELECT count(*) FROM h) AS hotspot_count FROM h, e""")
def hotspots(spark, d):
    return spatial.hotspots(_xy(spark, d))


@query("hotspots_by_window", S.with_views("trips") + f""",
e AS (SELECT hour(datetime)::INT AS hour, min(latitude) y0, max(latitude) y1, min(longitude) x0, max(longitude) x1 FROM trips GROUP BY 1),
c AS (SELECT e.hour, {_bin('latitude', 'y0', 'y1', 49)} AS iy, {_bin('longitude', 'x0', 'x1', 49)} AS ix, count(*) AS n, any_value(y0) y0, any_value(y1) y1, any_value(x0) x0, any_value(x1) x1
      FROM trips JOIN e ON hour(datetime) = e.hour GROUP BY 1, 2, 3),
s AS (SELECT hour, quantile_cont(n, 0.9) AS t, max(n) AS m, sum(n) AS s FROM c GROUP BY 1)
SELECT c.hour, round(y0 + (iy + 0.5) * (y1 - y0) / 49, 6) AS lat_center, round(x0 + (ix + 0.5) * (x1 - x0) / 49, 6) AS lon_center, n AS density,
  m AS max_density, round(s / 2401.0::DOUBLE, 6) AS mean_density FROM c JOIN s USING (hour) WHERE n >= t""")
def hotspots_by_window(spark, d):
    return spatial.hotspots_by(views.trips(spark, d), F.hour("datetime"), "hour")


_ST = """count(*) AS n, round(avg(latitude) + 3e-9, 6) AS center_lat, round(avg(longitude) + 3e-9, 6) AS center_lon,
  round(stddev_samp(latitude) + stddev_samp(longitude), 6) AS spread FROM trips GROUP BY 2"""


@query("spatiotemporal", S.T + f"SELECT 'hour' AS kind, {S.HR} AS k, {_ST} UNION ALL SELECT 'weekday', {S.WD}, {_ST}")
def spatiotemporal(spark, d):
    return spatial.space_time(views.trips(spark, d))


@query("spatial_patterns", S.T + """SELECT round(avg(latitude) + 3e-9, 6) AS center_lat, round(avg(longitude) + 3e-9, 6) AS center_lon,
  round(max(latitude) - min(latitude), 6) AS lat_range, round(max(longitude) - min(longitude), 6) AS lon_range,
  round((max(latitude) - min(latitude)) * (max(longitude) - min(longitude)), 6) AS total_area,
  round(count(*) / ((max(latitude) - min(latitude)) * (max(longitude) - min(longitude))), 4) AS point_density,
  round(sum(latitude * value) / sum(value), 6) AS weighted_lat, round(sum(longitude * value) / sum(value), 6) AS weighted_lon FROM trips""")
def spatial_patterns(spark, d):
    return spatial.spatial_patterns(views.trips(spark, d), "value")


@query("base_activity", S.with_views("trips") + """,
g AS (SELECT base_station AS b, count(*) AS n FROM trips GROUP BY 1)
SELECT * FROM (SELECT b AS most_active, n AS most_n FROM g ORDER BY n DESC, b LIMIT 1), (SELECT b AS least_active, n AS least_n FROM g ORDER BY n, b LIMIT 1)""")
def base_activity(spark, d):
    return spatial.base_activity(views.trips(spark, d))


_LABELLED = """,
l AS (SELECT *, (latitude >= 40.75)::INT * 3 + (longitude >= -74.1)::INT + (longitude >= -73.9)::INT AS cluster FROM trips)"""


@query("cluster_stats", S.with_views("trips") + _LABELLED + """,
c AS (SELECT cluster, count(*) AS size, avg(latitude) AS y, avg(longitude) AS x FROM l GROUP BY 1)
SELECT cluster, any_value(size) AS size, round(any_value(size) * 100.0::DOUBLE / (SELECT count(*) FROM l), 6) AS share_pct, round(any_value(y), 6) AS center_lat,
  round(any_value(x), 6) AS center_lon, round(avg(sqrt((latitude - y) * (latitude - y) + (longitude - x) * (longitude - x))), 6) AS radius
FROM l JOIN c USING (cluster) GROUP BY 1""")
def cluster_stats(spark, d):
    return cluster.cluster_stats(spatial.grid_labels(_xy(spark, d)))


@query("cluster_profile", S.with_views("trips") + _LABELLED + """
SELECT cluster, count(*) AS size, round(avg(latitude), 6) AS lat_mean, round(stddev_samp(latitude), 6) AS lat_std, round(avg(longitude), 6) AS lon_mean,
  round(stddev_samp(longitude), 6) AS lon_std, round(avg(value), 6) AS demand_mean, round(stddev_samp(value), 6) AS demand_std, round(sum(value), 4) AS demand_sum
FROM l GROUP BY 1""")
def cluster_profile(spark, d):
    return cluster.cluster_profile(spatial.grid_labels(views.trips(spark, d)), weight="value")


# ---- chart data ------------------------------------------------------------------------


def _hist_sql(table, col, bins):
    return f"""WITH e AS (SELECT min({col})::DOUBLE AS a, max({col})::DOUBLE AS b FROM {table}),
h AS (SELECT {_bin(f'{col}::DOUBLE', 'a', 'b', bins)} AS bin, count(*) AS n FROM {table}, e GROUP BY 1)
SELECT s.bin::INT AS bin, round(a + s.bin * ((b - a) / {bins}), 6) AS bin_left, round(a + (s.bin + 1) * ((b - a) / {bins}), 6) AS bin_right,
  coalesce(n, 0) AS n FROM e CROSS JOIN range({bins}) s(bin) LEFT JOIN h ON h.bin = s.bin"""


@query("histogram_bins", _hist_sql("lineitem", "l_extendedprice", 30))
def histogram_bins(spark, d):
    return chartdata.histogram(views.table(spark, d, "lineitem"), "l_extendedprice", 30)


@query("histogram_distance", _hist_sql("events", "value", 50))
def histogram_distance(spark, d):
    return chartdata.histogram(views.trips(spark, d), "value", 50)


@query("boxplot_stats", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3,
  round(min({c}) FILTER ({c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)), 6) AS whisker_low,
  round(max({c}) FILTER ({c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)), 6) AS whisker_high,
  count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM lineitem,
  (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.5) m, quantile_cont({c}, 0.75) b FROM lineitem) GROUP BY a, m, b"""
                                           for c in ("l_quantity", "l_extendedprice")))
def boxplot_stats(spark, d):
    return chartdata.box_stats(views.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("hist2d", S.with_views("trips") + f""", e AS ({_RANGE} FROM trips)
, h AS (SELECT {_bin('latitude', 'y0', 'y1', 50)} AS iy, {_bin('longitude', 'x0', 'x1', 50)} AS ix, count(*) AS n FROM trips, e GROUP BY 1, 2)
SELECT a.i::INT AS iy, b.i::INT AS ix, coalesce(n, 0) AS n FROM range(50) a(i) CROSS JOIN range(50) b(i) LEFT JOIN h ON h.iy = a.i AND h.ix = b.i""")
def hist2d(spark, d):
    return chartdata.hist2d(_xy(spark, d))


@query("hexbin", S.with_views("trips") + f""", e AS ({_RANGE} FROM trips),
p AS (SELECT round((longitude - x0) / ((x1 - x0) / 50), 9) AS u, round((latitude - y0) / ((y1 - y0) / 28), 9) AS v FROM trips, e),
k AS (SELECT *, round(pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) - pow(u - floor(u) - 0.5, 2) - 3 * pow(v - floor(v) - 0.5, 2), 9) AS diff FROM p),
h AS (SELECT CASE WHEN diff < 0 THEN 0 ELSE 1 END AS lattice, CASE WHEN diff < 0 THEN floor(u + 0.5) ELSE floor(u) END AS ix,
  CASE WHEN diff < 0 THEN floor(v + 0.5) ELSE floor(v) END AS iy, count(*) AS n FROM k GROUP BY 1, 2, 3)
SELECT lattice, ix::INT AS ix, iy::INT AS iy, round(x0 + (ix + lattice * 0.5) * ((x1 - x0) / 50), 6) AS center_x,
  round(y0 + (iy + lattice * 0.5) * ((y1 - y0) / 28), 6) AS center_y, n FROM h, e""")
def hexbin(spark, d):
    return chartdata.hexbin(_xy(spark, d))


@query("kde_grid", S.with_views("trips") + """,
s AS (SELECT count(*)::DOUBLE AS n, pow(count(*), -1.0 / 3) AS h2, var_samp(latitude) AS vy, var_samp(longitude) AS vx, covar_samp(latitude, longitude) AS c,
        min(latitude) y0, max(latitude) y1, min(longitude) x0, max(longitude) x1 FROM trips),
p AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM trips GROUP BY 1, 2),
g AS (SELECT i::INT AS iy, j::INT AS ix, y0 + i * (y1 - y0) / 99 AS gy, x0 + j * (x1 - x0) / 99 AS gx, s.* EXCLUDE (y0, y1, x0, x1), (vy * vx - c * c) * h2 AS dd
      FROM range(100) a(i), range(100) b(j), s)
SELECT iy, ix, round(sum(p.n * exp(-0.5 * (vx * (y - gy) * (y - gy) + vy * (x - gx) * (x - gx) - 2 * c * (y - gy) * (x - gx)) / dd))
  / (2 * pi() * any_value(sqrt(vy * vx - c * c) * h2 * g.n)), 6) AS density FROM g, p GROUP BY 1, 2""")
def kde_grid(spark, d):
    return chartdata.kde_grid(_xy(spark, d))


@query("heat_points", S.with_views("trips") + """
SELECT floor(round(latitude * 100, 6)) / 100 AS lat, round(floor(round(longitude * 100, 6)) / 100, 6) AS lon, round(sum(value), 4) AS weight,
  (SELECT round(avg(latitude), 5) FROM trips) AS center_lat, (SELECT round(avg(longitude), 5) FROM trips) AS center_lon FROM trips GROUP BY 1, 2""")
def heat_points(spark, d):
    return chartdata.heat_cells(views.trips(spark, d), "value")


@query("marker_clusters", S.T + f"""SELECT floor(round(latitude / {360.0 / 2**11 * 80 / 256!r}::DOUBLE, 9))::BIGINT AS cy,
  floor(round(longitude / {360.0 / 2**11 * 80 / 256!r}::DOUBLE, 9))::BIGINT AS cx, count(*) AS n, round(avg(latitude), 5) AS lat, round(avg(longitude), 5) AS lon
FROM trips GROUP BY 1, 2""")
def marker_clusters(spark, d):
    return chartdata.marker_cells(_xy(spark, d), 11)


@query("choropleth_values", """SELECT n_name AS region, round(avg(c_acctbal), 4) AS mean_value, round(sum(c_acctbal), 2) AS sum_value, count(c_custkey) AS n
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""")
def choropleth_values(spark, d):
    return chartdata.region_values(views.table(spark, d, "customer"), views.table(spark, d, "nation"),
                                   "c_nationkey", "n_nationkey", "n_name", "c_acctbal")


