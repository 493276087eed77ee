"""Declared schemas and fixed settings of the trip data model."""

from __future__ import annotations

from pyspark.sql import types as T

TRIP_RAW = T.StructType(
    [
        T.StructField("Date/Time", T.StringType()),
        T.StructField("Lat", T.DoubleType()),
        T.StructField("Lon", T.DoubleType()),
        T.StructField("Base", T.StringType()),
    ]
)

TRIP = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("base_station", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)

BASE_DAILY = T.StructType(
    [
        T.StructField("dispatching_base_number", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("active_vehicles", T.IntegerType()),
        T.StructField("trips", T.IntegerType()),
    ]
)

RIDE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("vehicle_id", T.LongType()),
        T.StructField("pickup_area", T.StringType()),
        T.StructField("wait_time", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("as_of", T.TimestampNTZType()),
        T.StructField("severity", T.StringType()),
    ]
)

# They must equal the ones used by existing trip reports.
LAT_MIN, LAT_MAX = 40.5, 41.0
LON_MIN, LON_MAX = -74.3, -73.7
CENTER_LAT, CENTER_LON = 40.7128, -74.0060
GRID_STEP = 0.01
PEAK_HOURS = (7, 8, 9, 17, 18, 19)
LAG_HOURS = (1, 2, 3, 6, 12, 24)
ROLLING_HOURS = (3, 6, 12, 24)
RAW_TIME_FORMAT = "M/d/yyyy H:mm:ss"
RAW_TO_CANONICAL = {
    "Date/Time": "datetime",
    "Lat": "latitude",
    "Lon": "longitude",
    "Base": "base_station",
}
