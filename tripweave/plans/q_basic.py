"""Queries: sources and sinks, projections, filters, time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import calendar as cal
from ..functions.geo import grid_index, haversine_atan_km, haversine_km, euclid_km, in_city, in_world
from ..functions.numbers import human_number, r
from ..operators import clean
from ..schema import CENTER_LAT, CENTER_LON, LAT_MIN, LON_MIN, TRIP_RAW
from ..session import scratch_path
from ..sources import files, sampling
from . import sqltext as S
from .registry import query

_RAW_SQL = S.T + """SELECT event_id, strftime(datetime, '%-m/%-d/%Y %-H:%M:%S') AS time_text,
  latitude, longitude, base_station FROM trips"""


def raw_copy(spark, sf_dir, tag):
    """A CSV copy of the trips in two folders, in the shape of the raw files."""
    root = scratch_path(spark, tag)
    raw = views.raw_trips(spark, sf_dir).drop("event_id")
    for i, odd in enumerate(("trips-raw-a.csv", "trips-raw-b.csv")):
        part = raw.where(F.pmod(F.xxhash64("Date/Time"), F.lit(2)) == i)
        files.write_any(part, f"{root}/{odd}")
    return root


_CSV_SQL = S.T + """SELECT strftime(datetime, '%-m/%-d/%Y %-H:%M:%S') AS time_text, latitude AS lat,
  longitude AS lon, base_station AS base, 1 AS has_source FROM trips"""


@query("scan_trip_csv", _CSV_SQL)
def scan_trip_csv(spark, d):
    root = raw_copy(spark, d, "scan-csv")
    df = files.read_trip_csv(spark, f"{root}/trips-raw-*.csv")
    return df.select(F.col("Date/Time").alias("time_text"), F.col("Lat").alias("lat"), F.col("Lon").alias("lon"),
                     F.col("Base").alias("base"), F.col("source_file").isNotNull().cast("int").alias("has_source"))


@query("scan_single_file", S.T + """SELECT base_station AS "Base", 'one.csv' AS source_file, count(*) AS n
  FROM trips GROUP BY 1""")
def scan_single_file(spark, d):
    path = scratch_path(spark, "single") + "/one.csv"
    files.write_any(views.raw_trips(spark, d).drop("event_id"), path)
    return files.read_single_csv(spark, path).groupBy("Base", "source_file").agg(F.count("*").alias("n"))


@query("scan_latest_processed", S.T + """SELECT event_id, datetime, latitude, longitude, base_station
  FROM trips WHERE datetime >= TIMESTAMP '2024-01-16'""")
def scan_latest_processed(spark, d):
    root = scratch_path(spark, "processed")
    t = views.trips(spark, d).select("event_id", "datetime", "latitude", "longitude", "base_station")
    files.write_any(t.where("datetime < '2024-01-16'"), f"{root}/trips_20240101.parquet")
    files.write_any(t.where("datetime >= '2024-01-16'"), f"{root}/trips_20240116.parquet")
    return files.read_latest(spark, root, "trips_*.parquet", t.schema)


@query("sink_processed", S.T + "SELECT datetime::DATE AS date, count(*) AS n FROM trips GROUP BY 1")
def sink_processed(spark, d):
    path = scratch_path(spark, "sink") + "/trips.parquet"
    t = views.trips(spark, d).withColumn("date", F.to_date("datetime"))
    files.write_any(t, path, partition_by="date")
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"))


@query("scan_all_sources", S.T + """SELECT 'trips' AS source, count(*) AS n FROM trips
  UNION ALL SELECT 'other', count(*) FROM trips""")
def scan_all_sources(spark, d):
    root = raw_copy(spark, d, "all-sources")
    other = views.trips(spark, d).select("event_id", "base_station")
    files.write_any(other, f"{root}/other-a.csv")
    got = files.load_all_sources(
        spark, {"trips": f"{root}/trips-raw-*.csv", "other": f"{root}/other-*.csv", "fhv": f"{root}/fhv-*.csv"},
        {"trips": TRIP_RAW, "other": other.schema})
    out = None
    for name, df in sorted(got.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _generic(kind):
    def run(spark, d):
        path = scratch_path(spark, f"generic-{kind}") + f"/orders.{kind}"
        src = views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
        files.write_any(src, path)
        return files.read_any(spark, path, src.schema)
    return run


for _k in ("csv", "json", "parquet"):
    query("scan_generic" if _k == "parquet" else f"scan_generic_{_k}",
          "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(_generic(_k))


@query("sink_generic", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sink_generic(spark, d):
    path = files.write_any(views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"),
                           scratch_path(spark, "sinkg") + "/orders.json")
    return files.read_any(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("scan_base_daily", S.T + """SELECT base_station AS dispatching_base_number, datetime::DATE AS date,
  count(DISTINCT vehicle_id)::INT AS active_vehicles, count(*)::INT AS trips FROM trips GROUP BY 1, 2""")
def scan_base_daily(spark, d):
    path = scratch_path(spark, "base-daily") + "/base-daily.csv"
    daily = views.trips(spark, d).groupBy(
        F.col("base_station").alias("dispatching_base_number"),
        F.date_format("datetime", "M/d/yyyy").alias("date")).agg(
        F.countDistinct("vehicle_id").alias("active_vehicles"), F.count("*").alias("trips"))
    daily.write.option("header", True).option("lineSep", "\n").csv(path)
    return files.read_base_daily(spark, path)


@query("data_catalog")
def data_catalog(spark, d):
    root = raw_copy(spark, d, "catalog")
    files.write_any(views.trips(spark, d), f"{root}/trips.parquet")
    return files.catalog(spark, root)


@query("sample_random", S.T + """SELECT event_id, datetime, base_station FROM trips
  ORDER BY md5('42:' || event_id::VARCHAR), event_id LIMIT 500""")
def sample_random(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "base_station")
    return sampling.sample_random(t, 500, "event_id")


@query("sample_systematic", S.T + """SELECT event_id, datetime, base_station FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () // 300 AS step FROM trips)
  WHERE i % step = 0 AND i < step * 300""")
def sample_systematic(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "base_station")
    return sampling.sample_systematic(t, 300, "event_id")


@query("sample_stratified", S.T + """SELECT event_id, datetime, base_station FROM (
  SELECT *, row_number() OVER (PARTITION BY base_station ORDER BY md5('42:' || event_id::VARCHAR), event_id) AS rk,
         (SELECT 400 // count(DISTINCT base_station) FROM trips) AS k FROM trips) WHERE rk <= k""")
def sample_stratified(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "base_station")
    return sampling.sample_stratified(t, 400, "base_station", "event_id")


# ---- projections and filters -------------------------------------------------


@query("canonicalize", S.T + """SELECT event_id, strftime(datetime, '%-m/%-d/%Y %-H:%M:%S') AS datetime,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE latitude END AS latitude, longitude, base_station FROM trips""")
def canonicalize(spark, d):
    raw = views.raw_trips(spark, d).withColumn(
        "Lat", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("Lat")))
    return clean.canonicalize(raw.withColumnsRenamed({"Lat": " Lat", "Base": "Base "}))


@query("filter_bbox", S.D + f"SELECT event_id, latitude, longitude FROM dirty WHERE {S.IN_CITY}")
def filter_bbox(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "latitude", "longitude")
    return t.where(in_city(F.col("latitude"), F.col("longitude")))


@query("filter_bbox_narrow", S.D + """SELECT event_id, latitude, longitude FROM dirty
  WHERE latitude BETWEEN 40.5 AND 41.0 AND longitude BETWEEN -74.1 AND -73.7""")
def filter_bbox_narrow(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "latitude", "longitude")
    return t.where(in_city(F.col("latitude"), F.col("longitude"), lon_min=-74.1))


@query("filter_world_bbox", S.D + """SELECT event_id, latitude, longitude FROM dirty
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180""")
def filter_world_bbox(spark, d):
    t = views.dirty_trips(spark, d).select("event_id", "latitude", "longitude")
    return t.where(in_world(F.col("latitude"), F.col("longitude")))


def dashboard_filter(df, start, end, hours=(), areas=(), time="datetime", area="pickup_area"):
    """Date range (both ends in), hours and areas; an empty list or 'all' does not filter."""
    cond = (F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (
        F.col(time) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if hours:
        cond = cond & F.hour(time).isin(*hours)
    if areas and "all" not in areas:
        cond = cond & F.col(area).isin(*areas)
    return df.where(cond)


@query("filter_dashboard", S.T + """SELECT event_id, datetime, pickup_area FROM trips
  WHERE datetime::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
    AND hour(datetime) IN (7, 8, 9, 18) AND pickup_area IN ('A1', 'A2', 'A3', 'A11')""")
def filter_dashboard(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "pickup_area")
    return dashboard_filter(t, "2024-01-05", "2024-01-20", (7, 8, 9, 18), ("A1", "A2", "A3", "A11"))


def filter_target(df, features, target):
    absent = [c for c in [*features, target] if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*features, target).dropna(subset=[target])


@query("filter_target_notnull", S.D + """SELECT event_id, longitude, latitude FROM dirty WHERE latitude IS NOT NULL""")
def filter_target_notnull(spark, d):
    return filter_target(views.dirty_trips(spark, d), ["event_id", "longitude"], "latitude")


def recent(df, minutes=60, time="datetime", as_of=None):
    """Rows younger than ``minutes`` before ``as_of`` (default: the latest row)."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else df.agg(F.max(time)).scalar()
    return df.where(F.col(time) > now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


@query("filter_recent", S.T + """SELECT event_id, datetime FROM trips
  WHERE datetime > (SELECT max(datetime) FROM trips) - INTERVAL 60 MINUTE""")
def filter_recent(spark, d):
    return recent(views.trips(spark, d).select("event_id", "datetime"), 60)


# ---- time features -------------------------------------------------------------


@query("time_features", S.T + f"""SELECT event_id, {S.HR} AS hour, day(datetime)::INT AS day, {S.WD} AS weekday,
  month(datetime)::INT AS month, quarter(datetime)::INT AS quarter, year(datetime)::INT AS year,
  dayofyear(datetime)::INT AS day_of_year, week(datetime)::INT AS week_of_year FROM trips""")
def time_features(spark, d):
    return views.trips(spark, d).select("event_id", *[c.alias(n) for n, c in cal.calendar_parts("datetime").items()])


_CYC = {"hour": ("hour(datetime)", 24), "day": ("day(datetime)", 31), "weekday": ("(isodow(datetime) - 1)", 7),
        "month": ("month(datetime)", 12)}


@query("cyclic_features", S.T + "SELECT event_id, " + ", ".join(
    f"round({f}(2 * pi() * {e} / {p}), 6) AS {n}_{f}" for n, (e, p) in _CYC.items() for f in ("sin", "cos"))
    + " FROM trips")
def cyclic_features(spark, d):
    parts = cal.calendar_parts("datetime")
    cols = []
    for n, (_, period) in _CYC.items():
        s, c = cal.cyclic_pair(parts[n], period)
        cols += [r(s).alias(f"{n}_sin"), r(c).alias(f"{n}_cos")]
    return views.trips(spark, d).select("event_id", *cols)


@query("day_part_flags", S.T + f"""SELECT event_id, (isodow(datetime) >= 6)::INT AS is_weekend, ({S.PEAK})::INT AS is_peak_hour,
  (hour(datetime) BETWEEN 6 AND 9)::INT AS is_morning, (hour(datetime) BETWEEN 12 AND 16)::INT AS is_afternoon,
  (hour(datetime) BETWEEN 17 AND 20)::INT AS is_evening,
  (hour(datetime) IN (21, 22, 23, 0, 1, 2, 3, 4, 5))::INT AS is_night FROM trips""")
def day_part_flags(spark, d):
    return views.trips(spark, d).select("event_id", *[c.alias(n) for n, c in cal.day_part_flags("datetime").items()])


@query("is_peak_hour", S.T + f"SELECT ({S.PEAK})::INT AS is_peak_hour, count(*) AS n FROM trips GROUP BY 1")
def is_peak_hour(spark, d):
    return (views.trips(spark, d).groupBy(cal.flag(cal.is_peak(F.hour("datetime"))).alias("is_peak_hour"))
            .agg(F.count("*").alias("n")))


def _holiday_sql(table, day):
    nth = ("make_date(y, {m}, 1) + ((({w} - isodow(make_date(y, {m}, 1)) + 7) % 7) + {k})::INT")
    rows = [nth.format(m=1, w=1, k=14), nth.format(m=2, w=1, k=14), nth.format(m=9, w=1, k=0),
            nth.format(m=10, w=1, k=7), nth.format(m=11, w=4, k=21),
            "make_date(y, 6, 1) - CASE WHEN isodow(make_date(y, 6, 1)) = 1 THEN 7 ELSE isodow(make_date(y, 6, 1)) - 1 END::INT"]
    fixed = ["make_date(y, 1, 1)", "CASE WHEN y >= 2021 THEN make_date(y, 6, 19) END", "make_date(y, 7, 4)",
             "make_date(y, 11, 11)", "make_date(y, 12, 25)"]
    return f"""years AS (SELECT unnest(range((SELECT min(year({day})) FROM {table}) - 1, (SELECT max(year({day})) FROM {table}) + 2)) AS y),
fixed AS (SELECT unnest([{', '.join(fixed)}]) AS h FROM years),
holidays AS (SELECT DISTINCT CAST(h AS DATE) AS h FROM (
  SELECT h FROM fixed WHERE h IS NOT NULL
  UNION ALL SELECT h - 1 FROM fixed WHERE isodow(h) = 6
  UNION ALL SELECT h + 1 FROM fixed WHERE isodow(h) = 7
  UNION ALL SELECT unnest([{', '.join(rows)}]) FROM years))"""


@query("holiday_flag", S.with_views("trips") + ",\n" + _holiday_sql("trips", "datetime")
       + " SELECT event_id, (datetime::DATE IN (SELECT h FROM holidays))::INT AS is_holiday FROM trips")
def holiday_flag(spark, d):
    return views.trips(spark, d).select("event_id", cal.flag(cal.is_us_holiday(F.to_date("datetime"))).alias("is_holiday"))


@query("holiday_orders", "WITH " + _holiday_sql("orders", "o_orderdate") + """
  SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders
  WHERE o_orderdate::DATE IN (SELECT h FROM holidays) GROUP BY 1""")
def holiday_orders(spark, d):
    day = F.to_date("o_orderdate")
    return (views.table(spark, d, "orders").where(cal.is_us_holiday(day)).groupBy(day.alias("day"))
            .agg(F.count("*").alias("n")))


@query("elapsed_features", S.T + """SELECT event_id,
  date_diff('second', date_trunc('day', datetime), date_trunc('second', datetime))::INT AS time_since_midnight,
  date_diff('second', date_trunc('week', datetime), date_trunc('second', datetime))::INT AS time_since_week_start FROM trips""")
def elapsed_features(spark, d):
    return views.trips(spark, d).select(
        "event_id", cal.seconds_since_midnight("datetime").alias("time_since_midnight"),
        cal.seconds_since_monday("datetime").alias("time_since_week_start"))


def extract_time_features(df, column):
    p = {k: c for k, c in cal.calendar_parts(column).items()}
    new = {f"{column}_{k}": p[k] for k in ("year", "month", "day", "hour", "weekday", "quarter")}
    new[f"{column}_minute"] = F.minute(column)
    new[f"{column}_week"] = p["week_of_year"]
    new[f"{column}_is_weekend"] = p["weekday"] >= 5
    new[f"{column}_is_workday"] = p["weekday"] < 5
    new[f"{column}_time_period"] = cal.time_period(p["hour"])
    return df.withColumns(new)


@query("time_features_helper", S.T + f"""SELECT event_id, datetime, year(datetime)::INT AS datetime_year,
  month(datetime)::INT AS datetime_month, day(datetime)::INT AS datetime_day, {S.HR} AS datetime_hour,
  minute(datetime)::INT AS datetime_minute, {S.WD} AS datetime_weekday, week(datetime)::INT AS datetime_week,
  quarter(datetime)::INT AS datetime_quarter, isodow(datetime) > 5 AS datetime_is_weekend,
  isodow(datetime) < 6 AS datetime_is_workday,
  CASE WHEN hour(datetime) < 6 OR hour(datetime) >= 22 THEN 'night' WHEN hour(datetime) < 12 THEN 'morning'
       WHEN hour(datetime) < 18 THEN 'afternoon' ELSE 'evening' END AS datetime_time_period FROM trips""")
def time_features_helper(spark, d):
    return extract_time_features(views.trips(spark, d).select("event_id", "datetime"), "datetime")


PEAK_LABEL_SQL = """CASE WHEN hour(datetime) IN (7, 8, 9) THEN 'morning_peak' WHEN hour(datetime) IN (17, 18, 19) THEN 'evening_peak'
       WHEN hour(datetime) IN (2, 3, 4, 5) THEN 'late_night' ELSE 'other' END"""


@query("peak_period_label", S.T + f"SELECT event_id, {PEAK_LABEL_SQL} AS peak_period FROM trips")
def peak_period_label(spark, d):
    return views.trips(spark, d).select("event_id", cal.peak_label(F.hour("datetime")).alias("peak_period"))


@query("format_number", """SELECT p_partkey,
  CASE WHEN x >= 1000000 THEN printf('%.2fM', round(x / 1000000, 2)) WHEN x >= 1000 THEN printf('%.2fK', round(x / 1000, 2))
       ELSE printf('%.2f', round(x, 2)) END AS label
  FROM (SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 ELSE p_size * 1048576 END)::DOUBLE AS x FROM part)""")
def format_number(spark, d):
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, F.col("p_size")).when(k == 1, F.col("p_size") * 1024).otherwise(F.col("p_size") * 1048576)
    return views.table(spark, d, "part").select("p_partkey", human_number(x.cast("double")).alias("label"))


# ---- plain spatial columns -------------------------------------------------------

_A_SQL = ("(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) "
          "* pow(sin(radians({x2} - {x1}) / 2), 2))")


@query("distance_to_center", S.T + "SELECT event_id, round(2 * 6371 * asin(sqrt("
       + _A_SQL.format(y1="latitude", x1="longitude", y2="40.7128", x2="-74.0060") + ")), 6) AS distance_to_center FROM trips")
def distance_to_center(spark, d):
    dist = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(CENTER_LAT), F.lit(CENTER_LON))
    return views.trips(spark, d).select("event_id", r(dist).alias("distance_to_center"))


_PAIR_A = _A_SQL.format(y1="latitude", x1="longitude", y2="(latitude + wait_time / 100)", x2="(longitude - wait_time / 50)")


@query("distance_pair", S.T + f"""SELECT event_id, round(2 * 6371 * atan2(sqrt({_PAIR_A}), sqrt(1 - {_PAIR_A})), 6) AS haversine_km,
  round(111 * sqrt(pow(wait_time / 100, 2) + pow(wait_time / 50, 2)), 6) AS euclid_km FROM trips""")
def distance_pair(spark, d):
    a, o = F.col("latitude"), F.col("longitude")
    a2, o2 = a + F.col("wait_time") / 100, o - F.col("wait_time") / 50
    return views.trips(spark, d).select("event_id", r(haversine_atan_km(a, o, a2, o2)).alias("haversine_km"),
                                        r(euclid_km(a, o, a2, o2)).alias("euclid_km"))


@query("grid_cell", S.T + """SELECT event_id, gy AS grid_lat, gx AS grid_lon, gy::VARCHAR || '_' || gx::VARCHAR AS grid_id FROM (
  SELECT event_id, trunc((latitude - 40.5::DOUBLE) / 0.01::DOUBLE)::INT AS gy,
         trunc((longitude - (-74.3)::DOUBLE) / 0.01::DOUBLE)::INT AS gx FROM trips)""")
def grid_cell(spark, d):
    gy, gx = grid_index(F.col("latitude"), LAT_MIN), grid_index(F.col("longitude"), LON_MIN)
    return views.trips(spark, d).select("event_id", gy.alias("grid_lat"), gx.alias("grid_lon"),
                                        F.concat_ws("_", gy, gx).alias("grid_id"))
