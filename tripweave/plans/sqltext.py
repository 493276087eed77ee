"""Oracle SQL fragments (DuckDB dialect) of the derived views."""

from __future__ import annotations

_TRIPS = """trips AS (
  SELECT event_id, ts AS datetime,
    40.48::DOUBLE + (user_id % 8) * 0.06::DOUBLE + ((event_id * 7919) % 1000) * 0.00011::DOUBLE AS latitude,
    (-74.32)::DOUBLE + (user_id % 5) * 0.12::DOUBLE + ((event_id * 6101) % 1000) * 0.00015::DOUBLE AS longitude,
    event_type AS base_station, user_id AS vehicle_id,
    'A' || (user_id % 20)::VARCHAR AS pickup_area,
    regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 5.0::DOUBLE AS wait_time,
    value
  FROM events)"""

_DIRTY = """dirty0 AS (
  SELECT event_id, datetime,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE latitude END AS latitude, longitude,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE base_station END AS base_station,
    vehicle_id, pickup_area, wait_time,
    CASE WHEN event_id % 101 = 0 THEN value * 50 ELSE value END AS value
  FROM trips),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE event_id % 53 = 0)"""

_HOURLY = """hour_counts AS (
  SELECT date_trunc('hour', datetime) AS hour, count(*) AS n FROM trips GROUP BY 1),
hourly AS (
  SELECT s.hour, coalesce(c.n, 0)::BIGINT AS demand
  FROM (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hour_counts) s
  LEFT JOIN hour_counts c ON s.hour = c.hour)"""

_BASE_HOURLY = """base_counts AS (
  SELECT base_station, date_trunc('hour', datetime) AS hour, count(*) AS n FROM trips GROUP BY 1, 2),
base_hourly AS (
  SELECT s.base_station, s.hour, coalesce(c.n, 0)::BIGINT AS demand
  FROM (SELECT base_station, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
        FROM base_counts GROUP BY base_station) s
  LEFT JOIN base_counts c ON s.hour = c.hour AND s.base_station = c.base_station)"""

_PRED = """predictions AS (
  SELECT hour, y, yhat FROM (
    SELECT hour, demand::DOUBLE AS y, lag(demand, 24) OVER (ORDER BY hour)::DOUBLE AS yhat FROM hourly)
  WHERE yhat IS NOT NULL)"""


_PARTS = {
    "trips": (_TRIPS, ()),
    "dirty": (_DIRTY, ("trips",)),
    "hourly": (_HOURLY, ("trips",)),
    "base_hourly": (_BASE_HOURLY, ("trips",)),
    "predictions": (_PRED, ("trips", "hourly")),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        text, needs = _PARTS[n]
        for m in needs:
            add(m)
        if text not in order:
            order.append(text)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(order)


T = with_views("trips") + "\n"
D = with_views("dirty") + "\n"
H = with_views("hourly") + "\n"
BH = with_views("base_hourly") + "\n"
P = with_views("predictions") + "\n"
IN_CITY = "latitude BETWEEN 40.5 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7"
WD = "(isodow(datetime) - 1)::INT"
HR = "hour(datetime)::INT"
PEAK = "hour(datetime) IN (7, 8, 9, 17, 18, 19)"
