"""Row features: business counts, codes, interactions, group statistics, full set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.geo import grid_index, haversine_km
from ..functions.numbers import r
from ..schema import CENTER_LAT, CENTER_LON, LAT_MIN, LON_MIN
from ..session import materialize, own_code
from .common import attach, numeric_columns, q, row_index, string_columns, tidy_stats
from .neighbours import density_features
from .series import add_lags, add_rolling, hourly_counts


def base_order_count(df: DataFrame, base: str = "base_station") -> DataFrame:
    """Rows of the same base, on every row."""
    return attach(df, df.where(F.col(base).isNotNull()).groupBy(base).agg(F.count("*").alias("base_order_count")), [base])


def codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): 0-based rank of every distinct non-null value."""
    values = df.select(column).where(q(column).isNotNull()).distinct()
    return row_index(values, [column], name).withColumn(name, q(name).cast("int"))


def label_encode(df: DataFrame, column: str, name: str | None = None, missing: int | None = None) -> DataFrame:
    name = name or f"{column}_encoded"
    out = attach(df, codes(df, column, name), [column]).select(*df.columns, name)
    return out if missing is None else out.withColumn(name, F.coalesce(name, F.lit(missing)))


def demand_history(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Number of rows at the same (hour, weekday), on every row."""
    d = df.withColumns({"_h": F.hour(time), "_w": F.weekday(time)})
    table = d.groupBy("_h", "_w").agg(F.count("*").alias("demand_forecast"))
    # at most 24 x 7 rows, so the broadcast cannot grow with the data
    return d.join(F.broadcast(table), ["_h", "_w"], "left").drop("_h", "_w").withColumn(
        "demand_forecast", F.coalesce("demand_forecast", F.lit(0).cast("long")))


def interactions(df: DataFrame, hour: str = "hour", weekend: str = "is_weekend", peak: str = "is_peak_hour",
                 distance: str = "distance_to_center", cluster: str | None = None) -> DataFrame:
    h, dist = F.col(hour), F.col(distance)
    new = {
        "hour_weekend_interaction": h * F.col(weekend),
        "distance_peak_interaction": dist * F.col(peak),
        "hour_squared": h * h,
        "hour_cubed": h * h * h,
        "distance_squared": dist * dist,
    }
    if cluster:
        new["hour_cluster_interaction"] = h * F.col(cluster)
    return df.withColumns(new)


def coordinate_stats(df: DataFrame, key: str, prefix: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.groupBy(key).agg(
        F.avg(lat).alias(f"{prefix}_lat_mean"), F.stddev_samp(lat).alias(f"{prefix}_lat_std"),
        F.avg(lon).alias(f"{prefix}_lon_mean"), F.stddev_samp(lon).alias(f"{prefix}_lon_std"),
        F.count(lat).alias(f"{prefix}_order_count"))


def stats_by_hour(df: DataFrame, hour: str = "hour") -> DataFrame:
    # 24 rows
    return df.join(F.broadcast(coordinate_stats(df, hour, "hour")), hour, "left")


def stats_by_base(df: DataFrame, base: str = "base_station") -> DataFrame:
    return attach(df, coordinate_stats(df.where(F.col(base).isNotNull()), base, "base"), [base])


def lag_features(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Hourly demand of earlier hours on every row."""
    table = add_lags(hourly_counts(df, time=time), "demand").withColumnRenamed("demand", "order_count")
    return attach(df.withColumn("hour_start", cal.hour_start(time)),
                  table.withColumnRenamed("hour", "hour_start"), ["hour_start"])


def rolling_features(df: DataFrame, time: str = "datetime") -> DataFrame:
    table = add_rolling(hourly_counts(df, time=time), "demand").withColumnRenamed("demand", "order_count")
    return attach(df.withColumn("hour_start", cal.hour_start(time)),
                  table.withColumnRenamed("hour", "hour_start"), ["hour_start"])


def time_feature_columns(time: str = "datetime") -> dict:
    parts = cal.calendar_parts(time)
    new = dict(parts) | cal.day_part_flags(time)
    for name, period in (("hour", 24), ("day", 31), ("weekday", 7), ("month", 12)):
        new[f"{name}_sin"], new[f"{name}_cos"] = cal.cyclic_pair(parts[name], period)
    new["is_holiday"] = cal.flag(cal.is_us_holiday(F.to_date(time)))
    new["time_since_midnight"] = cal.seconds_since_midnight(time)
    new["time_since_week_start"] = cal.seconds_since_monday(time)
    return new


def spatial_feature_columns(lat: str = "latitude", lon: str = "longitude") -> dict:
    a, o = F.col(lat), F.col(lon)
    gy, gx = grid_index(a, LAT_MIN), grid_index(o, LON_MIN)
    return {
        "distance_to_center": haversine_km(a, o, F.lit(CENTER_LAT), F.lit(CENTER_LON)),
        "grid_lat": gy, "grid_lon": gx, "grid_id": F.concat_ws("_", gy, gx),
    }


def all_features(df: DataFrame, cluster_sizes: Sequence[int] = (5, 8, 10)) -> DataFrame:
    """The full feature table: time, place, business, interaction, group, lag, rolling.

    The table is written once after the costly spatial step; the small hourly and
    per-base tables are then joined to it without moving its rows.
    """
    from .cluster import cluster_columns

    d = df.where(F.col("datetime").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    d = own_code(d.withColumns(time_feature_columns())).withColumns(spatial_feature_columns())
    d = cluster_columns(d, cluster_sizes)
    d = density_features(d, {"density_1km": 0.01, "density_5km": 0.05})
    d = materialize(d, "features-spatial")
    d = label_encode(base_order_count(d), "base_station")
    d = demand_history(d)
    d = interactions(d, cluster=f"cluster_{cluster_sizes[1]}" if len(cluster_sizes) > 1 else None)
    d = stats_by_hour(d)
    d = attach(d, coordinate_stats(df, "base_station", "base").drop("base_order_count"), ["base_station"])
    hourly = add_rolling(add_lags(hourly_counts(df), "demand"), "demand").withColumnsRenamed(
        {"hour": "hour_start", "demand": "order_count"})
    return attach(d.withColumn("hour_start", cal.hour_start("datetime")), hourly, ["hour_start"])


def feature_summary(df: DataFrame) -> DataFrame:
    """(column_name, column_class, missing)."""
    nums, texts = set(numeric_columns(df)), set(string_columns(df))
    t = tidy_stats(df, df.columns, {"missing": lambda c: F.count_if(c.isNull())})
    kind = (F.when(F.col("column_name").isin(*nums), "numeric")
            .when(F.col("column_name").isin(*texts), "text").otherwise("other"))
    return t.select("column_name", kind.alias("column_class"), "missing")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison across engines."""
    return df.select(*[r(q(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else q(f.name)
                       for f in df.schema.fields])
