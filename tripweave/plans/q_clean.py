"""Queries: cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import clean, quality
from . import sqltext as S
from .registry import query

_COLS = views.TRIP_COLUMNS
_NUM = ["event_id", "latitude", "longitude", "vehicle_id", "wait_time", "value"]
_TXT = ["base_station", "pickup_area"]


def _messy(spark, d):
    """Raw text times (some unreadable) with the planted gaps and repeats."""
    return views.dirty_trips(spark, d).select(
        "event_id",
        F.when(F.col("event_id") % 61 == 0, F.lit("not a time"))
        .otherwise(F.date_format("datetime", "M/d/yyyy H:mm:ss")).alias("Date/Time"),
        F.col("latitude").alias("Lat"), F.col("longitude").alias("Lon"), F.col("base_station").alias("Base"),
        F.when(F.col("event_id") % 83 != 0, F.col("value")).alias("value"))


_MESSY = S.with_views("dirty") + """,
messy AS (SELECT event_id, CASE WHEN event_id % 61 = 0 THEN NULL ELSE date_trunc('second', datetime) END AS datetime,
  latitude, longitude, base_station, CASE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value FROM dirty)"""
_TIME_COLS = f"""{S.HR} AS hour, day(datetime)::INT AS day, {S.WD} AS weekday, month(datetime)::INT AS month,
  quarter(datetime)::INT AS quarter, year(datetime)::INT AS year, datetime::DATE AS date,
  (isodow(datetime) > 5)::INT AS is_weekend, (hour(datetime) IN (7, 8, 9, 17, 18, 19))::INT AS is_peak_hour"""


@query("clean_datetime", _MESSY + f" SELECT event_id, datetime, {_TIME_COLS} FROM messy")
def clean_datetime(spark, d):
    m = clean.canonicalize(_messy(spark, d)).select("event_id", "datetime")
    return clean.process_datetime(m)


_PICK = "ORDER BY datetime NULLS FIRST, base_station NULLS FIRST, event_id"


@query("clean_coordinates", S.D + f"""SELECT {', '.join(_COLS)} FROM (SELECT *, row_number() OVER (
  PARTITION BY latitude, longitude {_PICK}) AS rn FROM dirty WHERE {S.IN_CITY}) WHERE rn = 1""")
def clean_coordinates(spark, d):
    return clean.clean_coordinates(views.dirty_trips(spark, d))


def _gaps(spark, d):
    return views.dirty_trips(spark, d).withColumn("value", F.when(F.col("event_id") % 83 != 0, F.col("value")))


@query("handle_missing", S.with_views("dirty") + """,
g AS (SELECT * REPLACE (CASE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value) FROM dirty
      WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND datetime IS NOT NULL)
SELECT * REPLACE (coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)) AS value,
  coalesce(base_station, (SELECT base_station FROM g WHERE base_station IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS base_station)
FROM g""")
def handle_missing(spark, d):
    return clean.handle_missing(_gaps(spark, d))


@query("remove_duplicates", S.D + f"""SELECT {', '.join(_COLS)} FROM (SELECT *, row_number() OVER (
  PARTITION BY datetime, latitude, longitude ORDER BY base_station NULLS FIRST, event_id) AS rn
  FROM (SELECT DISTINCT * FROM dirty)) WHERE rn = 1""")
def remove_duplicates(spark, d):
    return clean.remove_duplicates(views.dirty_trips(spark, d))


def _fence(src, col, dst, lo=0.05, hi=0.95, k=2.0):
    return f"""{dst} AS (SELECT s.* FROM {src} s, (SELECT quantile_cont({col}, {lo}) AS a, quantile_cont({col}, {hi}) AS b FROM {src}) f
  WHERE {col} >= a - {k} * (b - a) AND {col} <= b + {k} * (b - a))"""


@query("outliers_iqr_wide", S.with_views("dirty") + ",\n" + _fence("dirty", "latitude", "s1") + ",\n"
       + _fence("s1", "longitude", "s2") + ",\n" + _fence("s2", "value", "s3") + " SELECT event_id, latitude, longitude, value FROM s3")
def outliers_iqr_wide(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "latitude", "longitude", "value")
    return clean.remove_outliers_iqr(t, ["latitude", "longitude", "value"])


def _zcut(src, col, dst):
    return f"""{dst} AS (SELECT s.* FROM {src} s, (SELECT avg({col}) AS m, stddev_pop({col}) AS sd FROM {src}) f
  WHERE abs(({col} - m) / sd) < 3)"""


@query("outliers_zscore", S.with_views("dirty") + ",\n" + _zcut("dirty", "latitude", "s1") + ",\n"
       + _zcut("s1", "wait_time", "s2") + ",\n" + _zcut("s2", "value", "s3") + " SELECT event_id, latitude, wait_time, value FROM s3")
def outliers_zscore(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "latitude", "wait_time", "value")
    return clean.remove_outliers_zscore(t, ["latitude", "wait_time", "value"])


_CLEAN_CTES = _MESSY + f""",
timed AS (SELECT *, {_TIME_COLS} FROM messy),
placed AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude {_PICK}) AS rn
           FROM timed WHERE {S.IN_CITY}) WHERE rn = 1),
kept AS (SELECT * FROM placed WHERE datetime IS NOT NULL),
filled AS (SELECT * REPLACE (coalesce(value, (SELECT quantile_cont(value, 0.5) FROM kept)) AS value,
  coalesce(base_station, (SELECT base_station FROM kept WHERE base_station IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS base_station)
  FROM kept),
single AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY datetime, latitude, longitude ORDER BY base_station, event_id) AS rn FROM filled) WHERE rn = 1),
""" + _fence("single", "latitude", "f1") + ",\n" + _fence("f1", "longitude", "cleaned")


@query("clean_all_steps", _CLEAN_CTES + " SELECT * FROM cleaned")
def clean_all_steps(spark, d):
    return clean.clean_all(_messy(spark, d))


def _tidy_counts(src, cols, total):
    parts = [f"SELECT 'rows' AS check_name, count(*) AS check_value FROM {src}",
             f"SELECT 'columns', {total}",
             f"SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) FROM {src}"]
    parts += [f"SELECT 'missing:{n}', count(*) - count({c}) FROM {src}" for n, c in cols]
    return parts


@query("validate_cleaned", S.D + " UNION ALL ".join(_tidy_counts("dirty", [(c, c) for c in _COLS], len(_COLS)) + [
    f"SELECT 'coordinates_ok', bool_and(coalesce({S.IN_CITY}, false))::BIGINT FROM dirty",
    "SELECT 'datetime_ok', bool_and(datetime IS NOT NULL)::BIGINT FROM dirty",
    "SELECT 'issues', 2::BIGINT"]))
def validate_cleaned(spark, d):
    return quality.validate_cleaned(views.dirty_trips(spark, d))


@query("cleaning_report", _CLEAN_CTES + """,
b AS (SELECT 'rows' AS measure, count(*) AS x FROM messy UNION ALL SELECT 'columns', 6
  UNION ALL SELECT 'missing', 4 * count(*) - count(latitude) - count(base_station) - count(value) - (SELECT count(*) FROM messy) FROM messy
  UNION ALL SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) FROM messy),
a AS (SELECT 'rows' AS measure, count(*) AS x FROM cleaned UNION ALL SELECT 'columns', 15
  UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'duplicate_rows', 0)
SELECT measure, b.x AS before_value, a.x AS after_value, b.x - a.x AS removed,
  round((b.x - a.x) * 100.0::DOUBLE / nullif(b.x, 0), 6) AS removed_pct, (b.x > a.x)::INT AS improved
FROM a JOIN b USING (measure)""")
def cleaning_report(spark, d):
    m = _messy(spark, d)
    return quality.cleaning_report(m, clean.clean_all(m))


_RAW = S.with_views("dirty") + """,
raw AS (SELECT event_id, CASE WHEN event_id % 61 = 0 THEN 'not a time' ELSE strftime(datetime, '%-m/%-d/%Y %-H:%M:%S') END AS t,
  latitude, longitude, base_station, CASE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value FROM dirty)
"""


@query("validate_raw", _RAW + " UNION ALL ".join(_tidy_counts("raw", [
    ("event_id", "event_id"), ("Date/Time", "t"), ("Lat", "latitude"), ("Lon", "longitude"), ("Base", "base_station"),
    ("value", "value")], 6) + [
    "SELECT 'missing_required_columns', 0",
    "SELECT 'latitude_out_of_bounds', count(*) FROM raw WHERE latitude < 40.5 OR latitude > 41.0",
    "SELECT 'longitude_out_of_bounds', count(*) FROM raw WHERE longitude < -74.3 OR longitude > -73.7",
    "SELECT 'unreadable_times', count(*) FROM raw WHERE t NOT LIKE '_%/_%/% %:%'"]))
def validate_raw(spark, d):
    return quality.validate_raw(_messy(spark, d))


def _desc(c, src):
    return {"n": f"count({c})::DOUBLE", "mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 6)",
            "min": f"round(min({c})::DOUBLE, 6)", "q25": f"round(quantile_cont({c}, 0.25)::DOUBLE, 6)",
            "median": f"round(quantile_cont({c}, 0.5)::DOUBLE, 6)", "q75": f"round(quantile_cont({c}, 0.75)::DOUBLE, 6)",
            "max": f"round(max({c})::DOUBLE, 6)"}


@query("data_summary", S.D + " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, '{k}' AS stat, {e} AS value FROM dirty" for c in _NUM for k, e in _desc(c, 'dirty').items()]
    + [f"SELECT '{c}', 'missing', (count(*) - count({c}))::DOUBLE FROM dirty" for c in _COLS]
    + [f"SELECT '{c}', 'unique', count(DISTINCT {c})::DOUBLE FROM dirty" for c in _TXT]
    + [f"SELECT '{c}', 'top:' || v, n FROM (SELECT {c} AS v, count(*)::DOUBLE AS n FROM dirty WHERE {c} IS NOT NULL "
       f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)" for c in _TXT]))
def data_summary(spark, d):
    return quality.data_summary(views.dirty_trips(spark, d))


@query("clean_generic", S.D + "SELECT DISTINCT * FROM dirty WHERE latitude IS NOT NULL AND base_station IS NOT NULL")
def clean_generic(spark, d):
    return clean.clean_generic(views.dirty_trips(spark, d), True, "drop")


_MODE = "(SELECT {c} FROM u WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
for _how, _rep in {
    "mean": "coalesce(latitude, (SELECT avg(latitude) FROM u)) AS latitude",
    "median": "coalesce(latitude, (SELECT quantile_cont(latitude, 0.5) FROM u)) AS latitude",
    "mode": f"coalesce(latitude, {_MODE.format(c='latitude')}) AS latitude, "
            f"coalesce(base_station, {_MODE.format(c='base_station')}) AS base_station",
}.items():
    query(f"clean_generic_{_how}", S.with_views("dirty") + f""",
u AS (SELECT DISTINCT * FROM dirty)
SELECT event_id, round(latitude, 6) AS latitude, base_station FROM (SELECT * REPLACE ({_rep}) FROM u)""")(
        lambda spark, d, how=_how: clean.clean_generic(views.dirty_trips(spark, d), True, f"fill_{how}").select(
            "event_id", F.round("latitude", 6).alias("latitude"), "base_station"))

_OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _out_sql(method, k):
    parts = []
    for c in _OUT_COLS:
        if method == "iqr":
            b = f"SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem"
            cond = f"{c} < a - {k} * (b - a) OR {c} > b + {k} * (b - a)"
        else:
            b = f"SELECT avg({c}) AS a, stddev_samp({c}) AS b FROM lineitem"
            cond = f"abs(({c} - a) / b) > {k}"
        parts.append(f"""SELECT '{c}' AS column_name, count(*) FILTER ({cond}) AS outlier_count,
          round((count(*) FILTER ({cond})) * 100.0::DOUBLE / count(*), 6) AS outlier_pct FROM lineitem, ({b})""")
    return " UNION ALL ".join(parts)


@query("detect_outliers", _out_sql("iqr", 0.5))
def detect_outliers(spark, d):
    return quality.detect_outliers(views.table(spark, d, "lineitem"), _OUT_COLS, "iqr", 0.5)


@query("detect_outliers_zscore", _out_sql("zscore", 1.5))
def detect_outliers_zscore(spark, d):
    return quality.detect_outliers(views.table(spark, d, "lineitem"), _OUT_COLS, "zscore", 1.5)


@query("detect_outliers_members", S.D + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, event_id FROM dirty, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM dirty)
    WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)""" for c in ("latitude", "value")))
def detect_outliers_members(spark, d):
    return quality.outlier_members(views.dirty_trips(spark, d), ["latitude", "value"], "event_id")


def _summary_sql():
    parts = []
    for c in _NUM:
        e = _desc(c, "dirty")
        parts.append(f"""SELECT '{c}' AS column_name, 'numeric' AS kind, count(*) AS n, count(*) - count({c}) AS missing,
          round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct, {e['mean']} AS mean, {e['median']} AS median,
          {e['std']} AS std, {e['min']} AS min, {e['max']} AS max, {e['q25']} AS q25, {e['q75']} AS q75,
          NULL::BIGINT AS unique_values, NULL::VARCHAR AS most_common, NULL::BIGINT AS most_common_count FROM dirty""")
    for c in _TXT:
        parts.append(f"""SELECT '{c}', 'categorical', count(*), count(*) - count({c}),
          round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          count(DISTINCT {c}), (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
          (SELECT count(*) AS k FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 1) FROM dirty""")
    return S.D + " UNION ALL ".join(parts)


@query("summary_statistics", _summary_sql())
def summary_statistics(spark, d):
    return quality.summary_statistics(views.dirty_trips(spark, d), _NUM + _TXT)


@query("validate_types", """SELECT 'o_orderkey' AS column_name, 'BIGINT' AS expected_type, 'valid' AS status, 0::BIGINT AS bad_values
  UNION ALL SELECT 'o_orderpriority', 'DOUBLE', 'invalid', count(*) FILTER (TRY_CAST(o_orderpriority AS DOUBLE) IS NULL) FROM orders
  UNION ALL SELECT 'o_totalprice', 'DOUBLE', 'valid', 0 UNION ALL SELECT 'o_absent', 'DATE', 'missing', 0""")
def validate_types(spark, d):
    return quality.validate_types(views.table(spark, d, "orders"), {
        "o_orderkey": "BIGINT", "o_orderpriority": "DOUBLE", "o_totalprice": "DOUBLE", "o_absent": "DATE"})
