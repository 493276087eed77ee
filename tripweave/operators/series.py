"""Hourly series: dense grids, lags, rolling figures, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.calendar import hour_start, minute_start
from ..schema import LAG_HOURS, ROLLING_HOURS


def _w(keys: Sequence[str], order: str):
    # without keys the frame covers a table of hours, minutes or days, whose
    # length grows with the calendar and not with the number of trips
    return W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order)


def fill_hours(grouped: DataFrame, keys: Sequence[str] = (), time: str = "hour") -> DataFrame:
    """Insert the missing hours between the first and the last one of each series.

    Every row is exploded up to the next existing hour, so no second pass over
    the source and no join is needed.  ``is_gap`` marks inserted rows.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    steps = F.sequence(F.col(time), F.coalesce(F.col("_next") - hour, F.col(time)), hour)
    rest = [c for c in grouped.columns if c != time and c not in keys]
    return (grouped.withColumn("_next", F.lead(time).over(_w(keys, time))).withColumn("_t", F.explode(steps))
            .select(*keys, F.col("_t").alias(time), (F.col("_t") != F.col(time)).alias("is_gap"), *rest))


def hourly_counts(df: DataFrame, keys: Sequence[str] = (), time: str = "datetime") -> DataFrame:
    """Dense hourly number of rows per series; empty hours count 0."""
    n = df.where(F.col(time).isNotNull()).groupBy(*keys, hour_start(time).alias("hour")).agg(F.count("*").alias("demand"))
    return fill_hours(n, keys).select(
        *keys, "hour", F.when(F.col("is_gap"), F.lit(0)).otherwise(F.col("demand")).cast("long").alias("demand"))


def hourly_mean_ffill(df: DataFrame, value: str, keys: Sequence[str] = (), time: str = "datetime") -> DataFrame:
    """Hourly mean of a value; hours without data carry the last mean."""
    m = df.where(F.col(time).isNotNull()).groupBy(*keys, hour_start(time).alias("hour")).agg(F.avg(value).alias("y"))
    dense = fill_hours(m, keys)
    w = _w(keys, "hour").rowsBetween(W.unboundedPreceding, 0)
    return dense.select(*keys, "hour", F.last(F.when(~F.col("is_gap"), F.col("y")), ignorenulls=True).over(w).alias("y"))


def add_lags(series: DataFrame, value: str, lags: Sequence[int] = LAG_HOURS, keys: Sequence[str] = (),
             order: str = "hour", prefix: str = "order_count_lag") -> DataFrame:
    w = _w(keys, order)
    return series.withColumns({f"{prefix}_{k}": F.lag(value, k).over(w) for k in lags})


def add_rolling(series: DataFrame, value: str, windows: Sequence[int] = ROLLING_HOURS, keys: Sequence[str] = (),
                order: str = "hour", prefix: str = "order_count_rolling") -> DataFrame:
    new: dict[str, Column] = {}
    for n in windows:
        w = _w(keys, order).rowsBetween(-(n - 1), 0)
        new[f"{prefix}_mean_{n}"] = F.avg(value).over(w)
        new[f"{prefix}_std_{n}"] = F.stddev_samp(value).over(w)
        new[f"{prefix}_max_{n}"] = F.max(value).over(w)
        new[f"{prefix}_min_{n}"] = F.min(value).over(w)
    return series.withColumns(new)


def moving_average(df: DataFrame, n: int = 5, keys: Sequence[str] = (), time: str = "datetime") -> DataFrame:
    """Rows per existing minute and their mean over the last n existing minutes."""
    m = df.groupBy(*keys, minute_start(time).alias("minute")).agg(F.count("*").alias("orders"))
    w = _w(keys, "minute").rowsBetween(-(n - 1), 0)
    return m.withColumn("moving_avg", F.avg("orders").over(w))


CHUNK, CHAIN = 64, 4096  # rows in a chunk of the smoothing, chunks chained in one group


def chain_stretches(stretches: DataFrame, keys: Sequence[str], order: str, alpha: float = 0.1) -> DataFrame:
    """(keys, n, body, x1): the stretches (n, body, x1) of each key, one after the other by ``order``.

    A stretch turns a former value e into (1-alpha)^n * e + body, so a later stretch maps the body of the earlier ones.
    """
    keep = F.lit(1.0 - alpha)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("body"), F.lit(None).cast("double").alias("x1"))
    add = lambda a, s: F.struct(
        (a["n"] + s["n"]).alias("n"), (a["body"] * F.pow(keep, s["n"].cast("double")) + s["body"]).alias("body"), F.coalesce(a["x1"], s["x1"]).alias("x1"))
    each = F.sort_array(F.collect_list(F.struct(order, F.col("n").cast("long").alias("n"), "body", "x1")))
    return stretches.groupBy(*keys).agg(each.alias("_s")).select(*keys, F.aggregate("_s", start, add).alias("_e")).select(*keys, "_e.*")


def ewma_parts(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """(keys, n, body, x1): a stretch of e = alpha*x + (1-alpha)*e per key, ready to be chained.

    The recursion is linear, so n rows turn a former value e into (1-alpha)^n * e + body.  Rows are dealt by range of key
    and order, numbered within their partition, and folded per CHUNK of numbers by a sum of weighted values, before they are
    shuffled again; chunks are then chained by CHAIN of them, by partition and by key.  So one key, or one moment of it, may
    hold most rows.  Only values above 0 count.
    """
    keep = F.lit(1.0 - alpha)
    x = df.where(F.col(value) > 0).select(*keys, *order, F.col(value).cast("double").alias("_x"))
    by = [*keys, *order, "_x"]
    placed = x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.monotonically_increasing_id())
    back = (F.lit(CHUNK - 1) - F.col("_p") % CHUNK).cast("double")
    chunks = placed.withColumns({"_c": F.expr(f"_p div {CHUNK}"), "_w": F.pow(keep, back)}).groupBy(*keys, "_c").agg(
        F.count("*").alias("n"), F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.max("_w").alias("_last"), F.min_by("_x", "_p").alias("x1"))
    # weights count from the chunk's end; the last row of the key in the chunk has the largest one
    out = chunks.select(*keys, "_c", "n", (F.lit(alpha) * F.col("_s") / F.col("_last")).alias("body"), "x1")
    out = chain_stretches(out.withColumn("_g", F.expr(f"_c div {CHAIN}")), [*keys, "_g"], "_c", alpha)
    out = chain_stretches(out.withColumn("_q", F.shiftright("_g", 33 - 6 - 12)), [*keys, "_q"], "_g", alpha)
    return chain_stretches(out, keys, "_q", alpha)


def ewma_value(alpha: float = 0.1) -> Column:
    """Value of a stretch that starts with its first x: that one enters with weight 1, not alpha."""
    keep = F.lit(1.0 - alpha)
    return F.col("body") + keep * F.pow(keep, (F.col("n") - 1).cast("double")) * F.col("x1")


def ewma_final(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """(keys, n, ewma): the last smoothed value per key; no keys means one series."""
    if not keys:
        parts = ewma_parts(df.withColumn("_all", F.lit(0)), value, ["_all"], order, alpha)
        return parts.select("n", ewma_value(alpha).alias("ewma"))
    return ewma_parts(df, value, keys, order, alpha).select(*keys, "n", ewma_value(alpha).alias("ewma"))


def cumulative_days(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Rows per day and their running total."""
    daily = df.groupBy(F.to_date(time).alias("date")).agg(F.count("*").alias("n"))
    return daily.withColumn("cumulative", F.sum("n").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))


def differences(series: DataFrame, value: str, order: str = "hour", keys: Sequence[str] = ()) -> DataFrame:
    return series.withColumn("diff", F.col(value) - F.lag(value, 1).over(_w(keys, order)))
