"""Spatial summaries: bounds, density, outliers, hotspots, patterns in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import equal_width_bin
from ..functions.numbers import r, r_mean, ratio
from ..session import materialize, one_row
from .neighbours import distinct_points, radius_counts
from .quantile import exact_quantiles

BINS = 49


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(*[r(f(c)).alias(f"{n}_{s}") for n, c in (("lat", "latitude"), ("lon", "longitude"))
                    for s, f in (("min", F.min), ("max", F.max))])


def center(df: DataFrame) -> DataFrame:
    qs = exact_quantiles(df, {"latitude": [0.5], "longitude": [0.5]})
    return df.agg(r_mean(F.avg("latitude")).alias("lat_mean"), r_mean(F.avg("longitude")).alias("lon_mean")).select(
        "*", r(F.lit(qs["latitude"][0])).alias("lat_median"), r(F.lit(qs["longitude"][0])).alias("lon_median"))


def spread_of(df: DataFrame) -> DataFrame:
    return df.agg(r(F.max("latitude") - F.min("latitude")).alias("lat_range"),
                  r(F.max("longitude") - F.min("longitude")).alias("lon_range"),
                  r(F.stddev_samp("latitude")).alias("lat_std"), r(F.stddev_samp("longitude")).alias("lon_std"))


def probe_density(df: DataFrame, radii: dict[str, float]) -> DataFrame:
    """Neighbour counts of all rows among all rows: mean, population std, max.  Equal places are counted once and weighted."""
    pts = materialize(distinct_points(df), "density-points")
    out = None
    for name, radius in radii.items():
        c = radius_counts(pts, pts, radius)
        h, n = F.col("hits") - 1, F.col("n")
        c = c.join(pts, ["y", "x"]).select(h.alias("h"), n.cast("double").alias("n"))
        mean = F.sum(F.col("h") * F.col("n")) / F.sum("n")
        square = F.sum(F.col("h").cast("double") * F.col("h") * F.col("n")) / F.sum("n")
        one = c.agg(r(mean).alias("mean"), r(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std"), F.max("h").alias("max"))
        one = one.select(F.lit(name).alias("radius"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def geo_outliers(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Rows outside the fences per axis, and the distinct rows outside either."""
    qs = exact_quantiles(df, {"latitude": [0.25, 0.75], "longitude": [0.25, 0.75]})
    out = {}
    for c, (a, b) in qs.items():
        out[c] = (F.col(c) < F.lit(a - k * (b - a))) | (F.col(c) > F.lit(b + k * (b - a))) if a is not None else F.lit(False)
    lat, lon = out["latitude"], out["longitude"]
    union = df.where(lat | lon).distinct().agg(F.count("*").alias("n")).scalar()
    return df.agg(F.count_if(lat).alias("lat_outliers"), F.count_if(lon).alias("lon_outliers")).withColumn("total_outliers", union)


def hotspot_cells(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Non-empty cells of a grid over the data range: iy, ix, n, centre."""
    e = one_row(df.agg(F.min("latitude").alias("y0"), F.max("latitude").alias("y1"),
                       F.min("longitude").alias("x0"), F.max("longitude").alias("x1")))
    g = (df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
         .groupBy(equal_width_bin(F.col("latitude"), e["y0"], e["y1"], bins).alias("iy"),
                  equal_width_bin(F.col("longitude"), e["x0"], e["x1"], bins).alias("ix"))
         .agg(F.count("*").alias("n")))

    def mid(i: str, lo: float, hi: float) -> Column:
        return F.lit(lo) + (F.col(i) + 0.5) * F.lit((hi - lo) / bins)

    return g.select("iy", "ix", "n", mid("iy", e["y0"], e["y1"]).alias("lat_center"),
                    mid("ix", e["x0"], e["x1"]).alias("lon_center"))


def hotspots(df: DataFrame, bins: int = BINS, share: float = 0.9) -> DataFrame:
    """Cells at or above the quantile of non-empty cells, with grid-wide figures."""
    cells = materialize(hotspot_cells(df, bins), "hotspot-cells")  # at most bins x bins rows
    s = one_row(cells.agg(F.percentile("n", share).alias("t"), F.max("n").alias("m"), F.sum("n").alias("s")))
    if s["t"] is None:
        s = {"t": 0.0, "m": 0, "s": 0}
    hot = cells.where(F.col("n") >= F.lit(s["t"]))
    total = hot.agg(F.count("*").alias("c")).scalar()
    return hot.select(r(F.col("lat_center")).alias("lat_center"), r(F.col("lon_center")).alias("lon_center"),
                      F.col("n").alias("density"), F.lit(s["m"]).cast("long").alias("max_density"),
                      r(F.lit(s["s"] / float(bins * bins))).alias("mean_density"), total.alias("hotspot_count"))


def hotspots_by(df: DataFrame, key: Column, name: str, bins: int = BINS, share: float = 0.9) -> DataFrame:
    """The same per value of a time window, each value with its own range.

    Ranges come from one aggregate over the keys (a few dozen rows) that is
    broadcast back, so the rows are never shuffled whole.
    """
    d = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        key.alias(name), "latitude", "longitude")
    e = materialize(d.groupBy(name).agg(F.min("latitude").alias("y0"), F.max("latitude").alias("y1"),
                                        F.min("longitude").alias("x0"), F.max("longitude").alias("x1")), "hotspot-ranges")

    def cell(v: str, lo: str, hi: str) -> Column:
        pos = F.floor(F.round(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)) * float(bins), 9))
        return F.coalesce(F.least(pos, F.lit(bins - 1)), F.lit(0)).cast("int")

    j = d.join(e, name)
    cells = j.groupBy(name, cell("latitude", "y0", "y1").alias("iy"), cell("longitude", "x0", "x1").alias("ix")).agg(
        F.count("*").alias("n"), F.first("y0").alias("y0"), F.first("y1").alias("y1"),
        F.first("x0").alias("x0"), F.first("x1").alias("x1"))
    w = W.partitionBy(name)  # at most bins x bins cells per window value
    hot = cells.withColumns({"t": F.percentile("n", F.lit(share)).over(w), "m": F.max("n").over(w),
                             "s": F.sum("n").over(w)}).where(F.col("n") >= F.col("t"))
    cy = F.col("y0") + (F.col("iy") + 0.5) * (F.col("y1") - F.col("y0")) / bins
    cx = F.col("x0") + (F.col("ix") + 0.5) * (F.col("x1") - F.col("x0")) / bins
    return hot.select(name, r(cy).alias("lat_center"), r(cx).alias("lon_center"), F.col("n").alias("density"),
                      F.col("m").alias("max_density"), r(F.col("s") / float(bins * bins)).alias("mean_density"))


def space_time(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Count, centre and spread per hour and per weekday, in one scan."""
    d = df.select(F.hour(time).alias("h"), F.weekday(time).alias("w"), "latitude", "longitude")
    g = d.groupingSets([["h"], ["w"]], "h", "w").agg(
        F.count("*").alias("n"), F.avg("latitude").alias("a"), F.avg("longitude").alias("o"),
        (F.stddev_samp("latitude") + F.stddev_samp("longitude")).alias("s"), F.grouping("h").alias("no_h"))
    return g.select(F.when(F.col("no_h") == 0, "hour").otherwise("weekday").alias("kind"), F.coalesce("h", "w").alias("k"),
                    "n", r_mean(F.col("a")).alias("center_lat"), r_mean(F.col("o")).alias("center_lon"), r(F.col("s")).alias("spread"))


def spatial_patterns(df: DataFrame, weight: str | None = None) -> DataFrame:
    lat_r = F.max("latitude") - F.min("latitude")
    lon_r = F.max("longitude") - F.min("longitude")
    aggs = [r_mean(F.avg("latitude")).alias("center_lat"), r_mean(F.avg("longitude")).alias("center_lon"),
            r(lat_r).alias("lat_range"), r(lon_r).alias("lon_range"), r(lat_r * lon_r).alias("total_area"),
            r(ratio(F.count("*"), lat_r * lon_r), 4).alias("point_density")]
    if weight:
        aggs += [r(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(n)
                 for c, n in (("latitude", "weighted_lat"), ("longitude", "weighted_lon"))]
    return df.agg(*aggs)


def base_activity(df: DataFrame, base: str = "base_station") -> DataFrame:
    """Most and least active base; ties to the first name."""
    g = df.where(F.col(base).isNotNull()).groupBy(base).agg(F.count("*").alias("n"))
    return g.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(base).alias("b"), "n")).alias("most"),
                 F.min(F.struct("n", F.col(base).alias("b"))).alias("least")).select(
        F.col("most.b").alias("most_active"), F.col("most.n").alias("most_n"),
        F.col("least.b").alias("least_active"), F.col("least.n").alias("least_n"))


def grid_labels(df: DataFrame, names: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """A fixed 2 x 3 split of the city box as cluster labels, for label-based statistics."""
    lat, lon = names
    row = (F.col(lat) >= 40.75).cast("int")
    col = (F.col(lon) >= -74.1).cast("int") + (F.col(lon) >= -73.9).cast("int")
    return df.withColumn("cluster", row * 3 + col)
