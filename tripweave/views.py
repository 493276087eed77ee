"""The trip views that every registered query reads.

The driver's ``events`` table carries no coordinates, so position, area and
waiting time are derived from its keys by portable arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRIP_COLUMNS = [
    "event_id", "datetime", "latitude", "longitude", "base_station",
    "vehicle_id", "pickup_area", "wait_time", "value",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts AS datetime",
        "40.48D + (user_id % 8) * 0.06D + ((event_id * 7919) % 1000) * 0.00011D AS latitude",
        "-74.32D + (user_id % 5) * 0.12D + ((event_id * 6101) % 1000) * 0.00015D AS longitude",
        "event_type AS base_station",
        "user_id AS vehicle_id",
        "concat('A', CAST(user_id % 20 AS STRING)) AS pickup_area",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) / 5.0D AS wait_time",
        "value",
    )


def dirty_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with planted gaps, wild values and repeated rows."""
    t = trips(spark, sf_dir)
    eid = F.col("event_id")
    d = t.withColumns(
        {
            "latitude": F.when(eid % 97 != 0, F.col("latitude")),
            "base_station": F.when(eid % 89 != 0, F.col("base_station")),
            "value": F.when(eid % 101 == 0, F.col("value") * 50).otherwise(F.col("value")),
        }
    )
    # one scan: repeated rows come out of an exploded copy counter
    copies = F.when(eid % 53 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.withColumn("_copy", F.explode(copies)).drop("_copy")


def ride_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).select(
        "event_id", F.col("datetime").cast("timestamp").alias("timestamp"),
        "vehicle_id", "pickup_area", "wait_time", "latitude", "longitude",
    )


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips in the shape of the raw CSV files (text time, original headers)."""
    return trips(spark, sf_dir).select(
        F.date_format("datetime", "M/d/yyyy H:mm:ss").alias("Date/Time"),
        F.col("latitude").alias("Lat"),
        F.col("longitude").alias("Lon"),
        F.col("base_station").alias("Base"),
        "event_id",
    )
