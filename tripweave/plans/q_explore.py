"""Queries: counts, pivots, exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import calendar as cal
from ..functions.numbers import r_mean
from ..operators import explore, quality, spatial
from ..operators.neighbours import density_features
from ..session import materialize
from . import sqltext as S
from .q_basic import PEAK_LABEL_SQL
from .registry import query

_NUM = ["event_id", "latitude", "longitude", "vehicle_id", "wait_time", "value"]
_TXT = ["base_station", "pickup_area"]
_COLS = views.TRIP_COLUMNS
_KEY_SQL = {"hour": S.HR, "day": "day(datetime)::INT", "week": "week(datetime)::INT", "month": "month(datetime)::INT"}

for _k, _e in _KEY_SQL.items():
    query(f"pattern_stats_{_k}", S.T + f"""SELECT {_e} AS {_k}, count(value) AS n, round(avg(value) + 3e-9, 2) AS mean,
      round(stddev_samp(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max FROM trips GROUP BY 1""")(
        lambda spark, d, k=_k: explore.pattern_stats(views.trips(spark, d), k))

_COUNTS = {
    "hourly_counts": ("hour", S.HR, lambda: F.hour("datetime")),
    "weekday_counts": ("weekday", S.WD, lambda: F.weekday("datetime")),
    "monthly_counts": ("month", "month(datetime)::INT", lambda: F.month("datetime")),
    "day_of_month_counts": ("day", "day(datetime)::INT", lambda: F.dayofmonth("datetime")),
    "daily_counts": ("date", "datetime::DATE", lambda: F.to_date("datetime")),
}
for _n, (_c, _e, _f) in _COUNTS.items():
    query(_n, S.T + f"SELECT {_e} AS {_c}, count(*) AS n FROM trips GROUP BY 1")(
        lambda spark, d, c=_c, f=_f: explore.counts_by(views.trips(spark, d), f(), c))


@query("monthly_counts_orders", "SELECT month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_counts_orders(spark, d):
    return explore.counts_by(views.table(spark, d, "orders"), F.month("o_orderdate"), "month")


@query("weekday_weekend_hourly", S.with_views("trips") + """,
c AS (SELECT CASE WHEN isodow(datetime) > 5 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(datetime)::INT AS hour, count(*) AS n
      FROM trips GROUP BY 1, 2),
m AS (SELECT day_type, avg(n) AS type_mean FROM c GROUP BY 1)
SELECT day_type, hour, n, round(type_mean, 6) AS type_mean,
  round((SELECT type_mean FROM m WHERE day_type = 'weekend') / (SELECT type_mean FROM m WHERE day_type = 'weekday'), 6) AS weekend_ratio
FROM c JOIN m USING (day_type)""")
def weekday_weekend_hourly(spark, d):
    return explore.day_type_hours(views.trips(spark, d))


@query("peak_share", S.with_views("trips") + f""",
k AS (SELECT 'peak_period' AS kind, {PEAK_LABEL_SQL} AS label FROM trips
  UNION ALL SELECT 'is_peak_hour', ({S.PEAK})::INT::VARCHAR FROM trips
  UNION ALL SELECT 'is_weekend', (isodow(datetime) > 5)::INT::VARCHAR FROM trips)
SELECT kind, label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM trips), 6) AS pct FROM k GROUP BY 1, 2""")
def peak_share(spark, d):
    return explore.peak_shares(views.trips(spark, d))


def _pivot_sql(row, name, agg, empty):
    cells = ", ".join(f"{agg.format(c=f'FILTER (hour(datetime) = {h})')} AS h{h}" for h in range(24))
    return S.T + f"SELECT {row} AS {name}, {cells} FROM trips GROUP BY 1"


@query("heatmap_weekday_hour", _pivot_sql(S.WD, "weekday", "count(*) {c}", 0))
def heatmap_weekday_hour(spark, d):
    return explore.pivot_hours(views.trips(spark, d), F.weekday("datetime"), "weekday")


@query("heatmap_mean", _pivot_sql("dayname(datetime)", "weekday_name", "round(avg(value) {c} + 3e-9, 6)", None))
def heatmap_mean(spark, d):
    return explore.pivot_hours(views.trips(spark, d), F.date_format("datetime", "EEEE"), "weekday_name", value="value")


@query("pivot_peak_hour", _pivot_sql(PEAK_LABEL_SQL, "peak_period", "count(*) {c}", 0))
def pivot_peak_hour(spark, d):
    return explore.pivot_hours(views.trips(spark, d), cal.peak_label(F.hour("datetime")), "peak_period")


for _n, _c, _e, _f in (("trend_daily_mean", "date", "datetime::DATE", lambda: F.to_date("datetime")),
                       ("trend_hour_mean", "hour", S.HR, lambda: F.hour("datetime")),
                       ("trend_weekday_mean", "weekday", S.WD, lambda: F.weekday("datetime"))):
    query(_n, S.T + f"SELECT {_e} AS {_c}, round(avg(value) + 3e-9, 6) AS mean_value FROM trips GROUP BY 1")(
        lambda spark, d, c=_c, f=_f: views.trips(spark, d).groupBy(f().alias(c)).agg(r_mean(F.avg("value")).alias("mean_value")))


@query("key_metrics", S.T + f"""SELECT count(*) AS total_orders, round(avg(value) + 3e-9, 6) AS avg_distance,
  round(avg(({S.PEAK})::INT) * 100, 6) AS peak_pct, round(avg((isodow(datetime) > 5)::INT) * 100, 6) AS weekend_pct FROM trips""")
def key_metrics(spark, d):
    return explore.key_metrics(views.trips(spark, d), "value")


@query("basic_analysis", S.D + """SELECT 'rows' AS item, count(*)::DOUBLE AS value FROM dirty
  UNION ALL SELECT 'columns', 9 UNION ALL SELECT 'span_days', floor(epoch(max(datetime) - min(datetime)) / 86400) FROM dirty
  UNION ALL SELECT 'lat_min', round(min(latitude), 6) FROM dirty UNION ALL SELECT 'lat_max', round(max(latitude), 6) FROM dirty
  UNION ALL SELECT 'lon_min', round(min(longitude), 6) FROM dirty UNION ALL SELECT 'lon_max', round(max(longitude), 6) FROM dirty
  UNION ALL SELECT 'unique_bases', count(DISTINCT base_station) FROM dirty
  UNION ALL SELECT 'base:' || base_station, count(*) FROM dirty WHERE base_station IS NOT NULL GROUP BY 1""")
def basic_analysis(spark, d):
    return explore.basic_analysis(views.dirty_trips(spark, d))


_TEMPORAL = f"""SELECT 'hour' AS kind, {S.HR} AS k, count(*) AS n FROM trips GROUP BY 2
  UNION ALL SELECT 'weekday', {S.WD}, count(*) FROM trips GROUP BY 2
  UNION ALL SELECT 'month', month(datetime)::INT, count(*) FROM trips GROUP BY 2
  UNION ALL SELECT 'is_peak_hour', ({S.PEAK})::INT, count(*) FROM trips GROUP BY 2"""
_PEAKS = """SELECT * FROM (SELECT 'peak_hour', k, n FROM h ORDER BY n DESC, k LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'off_peak_hour', k, n FROM h ORDER BY n, k LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'busiest_day', k, n FROM w ORDER BY n DESC, k LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'quietest_day', k, n FROM w ORDER BY n, k LIMIT 1)"""
_HW = f"""h AS (SELECT {S.HR} AS k, count(*) AS n FROM trips GROUP BY 1), w AS (SELECT {S.WD} AS k, count(*) AS n FROM trips GROUP BY 1)"""


@query("temporal_summary", S.with_views("trips") + f", {_HW} {_TEMPORAL} UNION ALL {_PEAKS}")
def temporal_summary(spark, d):
    c = materialize(explore.temporal_counts(views.trips(spark, d)), "temporal-counts")
    return c.unionByName(explore.peak_rows(c))


@query("spatial_summary", S.with_views("trips") + """,
p AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM trips GROUP BY 1, 2),
c AS (SELECT a.y, a.x, a.n, sum(b.n) - 1 AS d FROM p a JOIN p b
      ON b.y BETWEEN a.y - 0.02 AND a.y + 0.02 AND b.x BETWEEN a.x - 0.02 AND a.x + 0.02
         AND sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) < 0.01::DOUBLE GROUP BY 1, 2, 3),
t AS (SELECT v.* FROM trips v)
SELECT 'latitude' AS column_name, round(avg(latitude), 5) AS mean, round(stddev_samp(latitude), 5) AS std,
  round(min(latitude), 6) AS min, round(max(latitude), 6) AS max FROM t
UNION ALL SELECT 'longitude', round(avg(longitude), 5), round(stddev_samp(longitude), 5), round(min(longitude), 6), round(max(longitude), 6) FROM t
UNION ALL SELECT 'density_1km', round(avg(d), 5), round(stddev_samp(d), 5), min(d), max(d)
  FROM trips JOIN c ON latitude = y AND longitude = x""")
def spatial_summary(spark, d):
    from ..functions.numbers import r
    from ..operators.common import tidy_stats

    t = density_features(views.trips(spark, d).select("latitude", "longitude"), {"density_1km": 0.01})
    return tidy_stats(t, ["latitude", "longitude", "density_1km"], {
        "mean": lambda c: r(F.avg(c), 5), "std": lambda c: r(F.stddev_samp(c), 5),
        "min": lambda c: r(F.min(c).cast("double")), "max": lambda c: r(F.max(c).cast("double"))})


@query("eda_basic", S.D + f"""SELECT 'rows' AS item, count(*) AS value FROM dirty
  UNION ALL SELECT 'columns', {len(_COLS)} UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))
  UNION ALL """ + " UNION ALL ".join(f"SELECT 'unique:{c}', count(DISTINCT {c}) FROM dirty" for c in _COLS))
def eda_basic(spark, d):
    return explore.distinct_counts(views.dirty_trips(spark, d))


@query("eda_missing", S.D + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM dirty"
    for c in _COLS))
def eda_missing(spark, d):
    return explore.missing_table(views.dirty_trips(spark, d))


_EDA_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("eda_numeric", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75,
  round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem""" for c in _EDA_NUM))
def eda_numeric(spark, d):
    return explore.numeric_shape(views.table(spark, d, "lineitem"), _EDA_NUM)


@query("eda_categorical", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, 'top' || rk AS item, v, n FROM (
    SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk FROM part GROUP BY 1) WHERE rk <= 10
  UNION ALL SELECT '{c}', 'unique', NULL, count(DISTINCT {c}) FROM part
  UNION ALL SELECT '{c}', 'least', v, n FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 1)"""
                                            for c in ("p_brand", "p_type")))
def eda_categorical(spark, d):
    return explore.categorical_shape(views.table(spark, d, "part"), ["p_brand", "p_type"])


@query("eda_temporal", S.with_views("trips") + f", {_HW} " + f"""SELECT 'start' AS kind, NULL::INT AS k, NULL::BIGINT AS n, min(datetime) AS at FROM trips
  UNION ALL SELECT 'end', NULL, NULL, max(datetime) FROM trips
  UNION ALL SELECT 'days', NULL, floor(epoch(max(datetime) - min(datetime)) / 86400)::BIGINT, NULL FROM trips
  UNION ALL SELECT *, NULL FROM ({_PEAKS}) UNION ALL SELECT 'hour', k, n, NULL FROM h UNION ALL SELECT 'weekday', k, n, NULL FROM w""")
def eda_temporal(spark, d):
    return _temporal(views.trips(spark, d))


def _temporal(t):
    """Start, end, days, counts per hour and weekday, and their peaks."""
    e = t.agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
    secs = F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))
    no_ts, no_n, no_k = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("long"), F.lit(None).cast("int")
    span = e.select(F.explode(F.array(
        F.struct(F.lit("start").alias("kind"), no_k.alias("k"), no_n.alias("n"), F.col("a").alias("at")),
        F.struct(F.lit("end").alias("kind"), no_k.alias("k"), no_n.alias("n"), F.col("b").alias("at")),
        F.struct(F.lit("days").alias("kind"), no_k.alias("k"), F.floor(secs / 86400).alias("n"), no_ts.alias("at")))).alias("s")).select("s.*")
    c = materialize(explore.temporal_counts(t).where("kind in ('hour', 'weekday')"), "temporal-counts")
    counts = c.unionByName(explore.peak_rows(c)).withColumn("at", no_ts)
    return span.unionByName(counts)


@query("eda_spatial", S.D + """SELECT round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max, round(min(longitude), 6) AS lon_min,
  round(max(longitude), 6) AS lon_max, round(avg(latitude) + 3e-9, 6) AS lat_center, round(avg(longitude) + 3e-9, 6) AS lon_center FROM dirty""")
def eda_spatial(spark, d):
    t = views.dirty_trips(spark, d)
    return t.agg(F.round(F.min("latitude"), 6).alias("lat_min"), F.round(F.max("latitude"), 6).alias("lat_max"),
                 F.round(F.min("longitude"), 6).alias("lon_min"), F.round(F.max("longitude"), 6).alias("lon_max"),
                 r_mean(F.avg("latitude")).alias("lat_center"), r_mean(F.avg("longitude")).alias("lon_center"))


@query("eda_spatial_clusters", S.with_views("dirty") + """,
l AS (SELECT (latitude >= 40.75)::INT * 3 + (longitude >= -74.1)::INT + (longitude >= -73.9)::INT AS cluster FROM dirty),
c AS (SELECT cluster, count(*) AS n FROM l WHERE cluster IS NOT NULL GROUP BY 1)
SELECT cluster, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 6) AS pct,
  CASE WHEN cluster = (SELECT cluster FROM c ORDER BY n DESC, cluster LIMIT 1) THEN 'most_popular'
    WHEN cluster = (SELECT cluster FROM c ORDER BY n, cluster LIMIT 1) THEN 'least_popular' ELSE 'cluster' END AS kind FROM c""")
def eda_spatial_clusters(spark, d):
    return explore.cluster_popularity(spatial.grid_labels(views.dirty_trips(spark, d)))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
                               for i, a in enumerate(_CORR) for b in _CORR[i + 1:])


@query("correlation_matrix", _CORR_SQL)
def correlation_matrix(spark, d):
    return explore.correlations(views.table(spark, d, "lineitem"), _CORR)


_STRONG = ["latitude", "longitude", "wait_time", "double_wait", "value"]


@query("strong_correlations", S.with_views("trips") + ", t AS (SELECT *, wait_time * 2 + value / 100 AS double_wait FROM trips), c AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS correlation FROM t"
                            for i, a in enumerate(_STRONG) for b in _STRONG[i + 1:])
       + ") SELECT *, (SELECT round(avg(correlation), 5) FROM c) AS avg_correlation FROM c WHERE abs(correlation) > 0.7")
def strong_correlations(spark, d):
    t = views.trips(spark, d).withColumn("double_wait", F.col("wait_time") * 2 + F.col("value") / 100)
    return explore.strong_correlations(t, _STRONG)


@query("eda_outliers", S.D + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
  round(count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) * 100.0::DOUBLE / count(*), 6) AS outlier_pct,
  round(a - 1.5 * (b - a), 6) AS lower_bound, round(b + 1.5 * (b - a), 6) AS upper_bound, round(min({c})::DOUBLE, 6) AS min_value, round(max({c})::DOUBLE, 6) AS max_value
  FROM dirty, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM dirty) GROUP BY a, b""" for c in _NUM))
def eda_outliers(spark, d):
    return explore.outlier_table(views.dirty_trips(spark, d), _NUM)


@query("quality_score", S.with_views("dirty") + """,
x AS (SELECT *, vehicle_id::VARCHAR AS code FROM dirty),
m AS (SELECT (10 * count(*) - count(event_id) - count(datetime) - count(latitude) - count(longitude) - count(base_station) - count(vehicle_id)
        - count(pickup_area) - count(wait_time) - count(value) - count(code)) AS gaps, count(*) AS n FROM x),
u AS (SELECT (SELECT n FROM m) - count(*) AS dups FROM (SELECT DISTINCT * FROM x)),
s AS (SELECT gaps * 100.0::DOUBLE / (n * 10) AS miss, dups * 100.0::DOUBLE / n AS dup, gaps, dups FROM m, u),
z AS (SELECT *, greatest(0, 100 - CASE WHEN miss > 10 THEN 20 WHEN miss > 5 THEN 10 ELSE 0 END
   - CASE WHEN dup > 5 THEN 15 WHEN dup > 1 THEN 5 ELSE 0 END - 10)::BIGINT AS score FROM s)
SELECT score, round(miss, 6) AS missing_pct, round(dup, 6) AS duplicate_pct, 9::BIGINT AS consistent_columns, (score < 80)::INT AS advise_cleaning,
  (gaps > 0)::INT AS advise_fill, (dups > 0)::INT AS advise_dedupe, (score >= 90)::INT AS ready FROM z""")
def quality_score(spark, d):
    return explore.quality_score(views.dirty_trips(spark, d).withColumn("code", F.col("vehicle_id").cast("string")))


@query("quality_ratios", S.with_views("dirty") + f""",
g AS (SELECT {' + '.join(f'(count(*) - count({c}))' for c in _COLS)} AS gaps, count(*) AS n, {' + '.join(f'count(DISTINCT {c})' for c in _COLS)} AS u FROM dirty),
k AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM dirty))
SELECT round(1 - gaps / (n * {len(_COLS)})::DOUBLE, 6) AS completeness, round(u::DOUBLE / (n * {len(_COLS)}), 6) AS uniqueness,
  round(k.k::DOUBLE / n, 6) AS consistency FROM g, k""")
def quality_ratios(spark, d):
    return explore.quality_ratios(views.dirty_trips(spark, d))


def _clustered(t):
    from ..operators import cluster

    return cluster.kmeans(t.select("latitude", "longitude"), ["latitude", "longitude"], 8)


@query("eda_report")
def eda_report(spark, d):
    t = materialize(views.dirty_trips(spark, d), "eda-input")
    return explore.as_sections({
        "basic": explore.distinct_counts(t), "missing": explore.missing_table(t),
        "types": quality.validate_types(t, {"event_id": "BIGINT", "latitude": "DOUBLE", "base_station": "DOUBLE"}),
        "numeric": explore.numeric_shape(t, _NUM), "categorical": explore.categorical_shape(t, _TXT),
        "temporal": _temporal(t).withColumns({"k": F.coalesce(F.col("k").cast("string"), F.lit("")), "at": F.col("at").cast("string")}),
        "months": explore.temporal_counts(t).where("kind in ('month', 'is_peak_hour')").withColumn("k", F.col("k").cast("string")),
        "spatial": spatial.bounds(t), "clusters": explore.cluster_popularity(_clustered(t)).withColumn("cluster", F.col("cluster").cast("string")), "correlations": explore.correlations(t, _NUM),
        "outliers": explore.outlier_table(t, _NUM), "quality": explore.quality_score(t)})
