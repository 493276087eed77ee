"""Statistics that read the same on a stream and on a table of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import is_peak
from ..functions.numbers import r


def total_orders(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count("*").alias("total_orders"))


def hour_orders(df: DataFrame) -> DataFrame:
    """Rows per event-time hour."""
    return df.groupBy(F.window("timestamp", "1 hour").alias("w")).agg(F.count("*").alias("orders")).select(
        F.col("w.start").alias("hour_start"), "orders")


def peak_orders(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count_if(is_peak(F.hour("timestamp"))).alias("peak_hour_orders"))


def active_vehicles(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct vehicles per half hour; on a stream, ``first_sightings`` counts them exactly."""
    n = F.countDistinct("vehicle_id") if exact else F.approx_count_distinct("vehicle_id", 0.05)
    return df.groupBy(F.window("timestamp", "30 minutes").alias("w")).agg(n.alias("active_vehicles")).select(
        F.col("w.start").alias("window_start"), "active_vehicles")


def first_sightings(stream: DataFrame) -> DataFrame:
    """(window_start, active_vehicles): one row with 1 for the first sighting of a vehicle in a half hour.

    The pairs seen are keyed state that the watermark expires with their window, so the sums over all batches are exact counts.
    """
    seen = stream.where("vehicle_id IS NOT NULL").select(F.window("timestamp", "30 minutes").alias("w"), "vehicle_id").dropDuplicates(["w", "vehicle_id"])
    return seen.select(F.col("w.start").alias("window_start"), F.lit(1).cast("long").alias("active_vehicles"))


def window_rates(df: DataFrame, minutes: int = 30) -> DataFrame:
    """Rows per minute over sliding windows that start every minute."""
    return df.groupBy(F.window("timestamp", f"{minutes} minutes", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "n", r(F.col("n") / float(minutes)).alias("per_minute"))


def demand_surge(rates: DataFrame, limit: float = 2.0) -> DataFrame:
    return rates.where(F.col("per_minute") > limit)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps back to the zone-free type of the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def severity(value: Column, limit: Column, factor: float) -> Column:
    return F.when(value > limit * factor, "high").otherwise("medium")
