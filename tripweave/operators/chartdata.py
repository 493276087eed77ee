"""Aggregates that charts and maps draw: bins, boxes, hexagons, kernels, heat cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import equal_width_bin
from ..functions.numbers import r
from ..session import one_row, spread
from .common import q
from .neighbours import distinct_points
from .quantile import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Equal-width counts over the column's range: bin, left edge, right edge, n.

    Every bin has a row, empty ones with 0; per group if there is one.  A column without spread has one bin, one
    without values none.
    """
    e = one_row(df.agg(F.min(q(column)).cast("double").alias("a"), F.max(q(column)).cast("double").alias("b")))
    d = df.where(q(column).isNotNull())
    keys = [group] if group else []
    g = d.groupBy(*keys, equal_width_bin(q(column).cast("double"), e["a"], e["b"], bins).alias("bin")).agg(F.count("*").alias("n"))
    a, b = e["a"] or 0.0, e["b"] or 0.0
    step = (b - a) / bins
    if b > a:
        every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
        spine = g.select(*keys).distinct().select(*keys, every) if keys else df.sparkSession.range(1).select(every)
        on = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*keys, "bin"]]
        g = spine.alias("s").join(g.alias("h"), on, "left").select(
            *[F.col(f"s.{c}").alias(c) for c in [*keys, "bin"]], F.coalesce("h.n", F.lit(0).cast("long")).alias("n"))
    return g.select(*keys, "bin", r(F.lit(a) + F.col("bin") * F.lit(step)).alias("bin_left"),
                    r(F.lit(a) + (F.col("bin") + 1) * F.lit(step)).alias("bin_right"), "n")


def box_stats(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme data within k interquartile ranges), outliers."""
    qs = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    aggs = []
    for i, c in enumerate(columns):
        a, _, b = qs[c]
        v = q(c).cast("double")
        inside = F.lit(False) if a is None else v.between(a - k * (b - a), b + k * (b - a))
        aggs += [F.min(F.when(inside, v)).alias(f"lo{i}"), F.max(F.when(inside, v)).alias(f"hi{i}"),
                 F.count_if(v.isNotNull() & ~inside).alias(f"n{i}")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), *[r(F.lit(qs[c][j]).cast("double")).alias(n) for j, n in enumerate(("q1", "median", "q3"))],
        r(F.col(f"lo{i}")).alias("whisker_low"), r(F.col(f"hi{i}")).alias("whisker_high"), F.col(f"n{i}").alias("outliers"))
        for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("s")).select("s.*")


def _all_nodes(df: DataFrame, n: int, cells: DataFrame, value: str, empty: Column) -> DataFrame:
    """Cells of an n x n grid (iy, ix, value); those without a row get ``empty``."""
    nodes = df.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("iy"), (F.col("id") % n).cast("int").alias("ix"))
    return nodes.join(cells, ["iy", "ix"], "left").select("iy", "ix", F.coalesce(value, empty).alias(value))


def hist2d(df: DataFrame, y: str = "latitude", x: str = "longitude", bins: int = 50) -> DataFrame:
    """Counts of all bins x bins cells of the data range; without data no cells."""
    e = one_row(df.agg(*[f(F.col(c)).alias(n) for n, f, c in (
        ("y0", F.min, y), ("y1", F.max, y), ("x0", F.min, x), ("x1", F.max, x))]))
    g = (df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
         .groupBy(equal_width_bin(F.col(y), e["y0"], e["y1"], bins).alias("iy"),
                  equal_width_bin(F.col(x), e["x0"], e["x1"], bins).alias("ix")).agg(F.count("*").alias("n")))
    return g if e["y0"] is None or e["x0"] is None else _all_nodes(df, bins, g, "n", F.lit(0).cast("long"))


def hexbin(df: DataFrame, y: str = "latitude", x: str = "longitude", gridsize: int = 50) -> DataFrame:
    """Counts per hexagon: every point goes to the nearer centre of two offset lattices."""
    e = one_row(df.agg(*[f(F.col(c)).alias(n) for n, f, c in (
        ("y0", F.min, y), ("y1", F.max, y), ("x0", F.min, x), ("x1", F.max, x))]))
    if e["y0"] is None:
        return df.limit(0).select(F.lit(0).alias("lattice"), F.lit(0).alias("ix"), F.lit(0).alias("iy"),
                                  F.lit(0.0).alias("center_x"), F.lit(0.0).alias("center_y"), F.lit(0).cast("long").alias("n"))
    rows = int(gridsize / math.sqrt(3))
    sx = (e["x1"] - e["x0"]) / gridsize or 1.0
    sy = (e["y1"] - e["y0"]) / rows or 1.0
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(
        F.round((F.col(x) - F.lit(e["x0"])) / F.lit(sx), 9).alias("u"), F.round((F.col(y) - F.lit(e["y0"])) / F.lit(sy), 9).alias("v"))
    u, v = F.col("u"), F.col("v")
    d1 = F.pow(u - F.floor(u + 0.5), 2) + 3 * F.pow(v - F.floor(v + 0.5), 2)
    d2 = F.pow(u - F.floor(u) - 0.5, 2) + 3 * F.pow(v - F.floor(v) - 0.5, 2)
    first = F.round(d1 - d2, 9) < 0
    g = d.groupBy(F.when(first, 0).otherwise(1).alias("lattice"),
                  F.when(first, F.floor(u + 0.5)).otherwise(F.floor(u)).alias("ix"),
                  F.when(first, F.floor(v + 0.5)).otherwise(F.floor(v)).alias("iy")).agg(F.count("*").alias("n"))
    half = F.col("lattice") * 0.5
    return g.select("lattice", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"),
                    r(F.lit(e["x0"]) + (F.col("ix") + half) * F.lit(sx)).alias("center_x"),
                    r(F.lit(e["y0"]) + (F.col("iy") + half) * F.lit(sy)).alias("center_y"), "n")


KDE_CELLS = 1 << 19  # kernel terms that a task computes as one array


def kde_grid(df: DataFrame, y: str = "latitude", x: str = "longitude", nodes: int = 100, reach: float = 9.0) -> DataFrame:
    """Gaussian kernel density on a grid of nodes: Scott bandwidth, full covariance.

    Equal places are merged and spread over the tasks.  Every task sums the
    kernels of its places in NumPy batches and emits one partial grid, so the
    shuffle carries grids, not pairs.  A place touches only the nodes within
    ``reach`` bandwidths: beyond 9 a term is below 1e-17 of the kernel's peak.
    The bandwidth shrinks as data grow, and with it the work per place.  All
    nodes are returned; one out of every place's reach has density 0, less than
    1e-17 of a kernel's peak from the truth.
    """
    s = one_row(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(
        F.count("*").alias("n"), F.var_samp(y).alias("vy"), F.var_samp(x).alias("vx"), F.covar_samp(y, x).alias("c"),
        F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1")))
    n = s["n"]
    if n < 3 or not s["vy"] or not s["vx"]:
        # no spread, no kernel
        return df.limit(0).select(F.lit(0).alias("iy"), F.lit(0).alias("ix"), F.lit(0.0).alias("density"))
    h2 = n ** (-1.0 / 3.0)  # squared Scott factor in two dimensions: n^(-1/6) squared
    vy, vx, c = s["vy"] * h2, s["vx"] * h2, s["c"] * h2
    det = vy * vx - c * c
    iy, ix, ic = vx / det, vy / det, -c / det
    norm = 1.0 / (2 * math.pi * math.sqrt(det) * n)
    gy, gx = np.linspace(s["y0"], s["y1"], nodes), np.linspace(s["x0"], s["x1"], nodes)
    ry, rx = reach * math.sqrt(vy), reach * math.sqrt(vx)

    sy, sx = gy[1] - gy[0], gx[1] - gx[0]
    # a place's window: as many nodes as its reach can cover, in a grid with a margin for windows that stick out
    my, mx = (min(nodes, int(2 * w / step) + 2) for w, step in ((ry, sy), (rx, sx)))
    step = max(1, KDE_CELLS // (my * mx))

    def partial(batches):
        wide = np.zeros((nodes + 2 * my) * (nodes + 2 * mx))
        for pdf in batches:
            for i in range(0, len(pdf), step):
                py, px, w = (pdf[c].to_numpy()[i:i + step] for c in ("y", "x", "n"))
                a = np.clip(np.ceil((py - ry - gy[0]) / sy), 1 - my, nodes).astype(np.int64)[:, None] + np.arange(my)
                b = np.clip(np.ceil((px - rx - gx[0]) / sx), 1 - mx, nodes).astype(np.int64)[:, None] + np.arange(mx)
                if my == nodes:
                    a = np.broadcast_to(np.arange(nodes), a.shape)
                if mx == nodes:
                    b = np.broadcast_to(np.arange(nodes), b.shape)
                ey, ex = gy[0] + a * sy - py[:, None], gx[0] + b * sx - px[:, None]
                e = (ey * ey * iy)[:, :, None] + (ex * ex * ix)[:, None, :] + (2 * ic * ey)[:, :, None] * ex[:, None, :]
                at = ((a + my) * (nodes + 2 * mx))[:, :, None] + (b + mx)[:, None, :]
                wide += np.bincount(at.ravel(), (w[:, None, None] * np.exp(-0.5 * e)).ravel(), len(wide))
        grid = wide.reshape(nodes + 2 * my, nodes + 2 * mx)[my:my + nodes, mx:mx + nodes]
        rows, cols = np.nonzero(grid)
        yield pd.DataFrame({"iy": rows.astype("int32"), "ix": cols.astype("int32"), "k": grid[rows, cols]})

    part = spread(distinct_points(df, y, x), "y", "x").mapInPandas(partial, "iy int, ix int, k double")
    dense = part.groupBy("iy", "ix").agg(r(F.sum("k") * F.lit(norm)).alias("density"))
    return _all_nodes(df, nodes, dense, "density", F.lit(0.0))


def heat_cells(df: DataFrame, weight: str | None = None, digits: int = 2, y: str = "latitude", x: str = "longitude") -> DataFrame:
    """Weighted points of a heat map, merged per small cell, with the map centre on every row."""
    scale = 10.0**digits
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.where(F.col(y).between(-90.0, 90.0) & F.col(x).between(-180.0, 180.0))
    mid = d.agg(F.avg(y).alias("y"), F.avg(x).alias("x"))
    cell = lambda c: F.floor(F.round(F.col(c) * scale, 6))
    g = d.groupBy(cell(y).alias("cy"), cell(x).alias("cx")).agg(F.sum(w).alias("w"))
    return g.select(r(F.col("cy") / scale).alias("lat"), r(F.col("cx") / scale).alias("lon"), r(F.col("w"), 4).alias("weight"),
                    r(mid.select("y").scalar(), 5).alias("center_lat"), r(mid.select("x").scalar(), 5).alias("center_lon"))


def marker_cells(df: DataFrame, zoom: int, y: str = "latitude", x: str = "longitude", pixels: int = 80) -> DataFrame:
    """Points that a map would draw as one marker at a zoom level: count and centroid per cell."""
    size = 360.0 / 2**zoom * pixels / 256.0
    cell = lambda c: F.floor(F.round(F.col(c) / F.lit(size), 9))
    return (df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(cell(y).alias("cy"), cell(x).alias("cx"))
            .agg(F.count("*").alias("n"), r(F.avg(y), 5).alias("lat"), r(F.avg(x), 5).alias("lon")))


def region_values(df: DataFrame, regions: DataFrame, key: str, region_key: str, name: str, value: str) -> DataFrame:
    """Mean and sum of a value per region; regions without rows are kept."""
    g = df.groupBy(key).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return regions.join(g, F.col(region_key) == F.col(key), "left").select(
        F.col(name).alias("region"), r(F.col("m"), 4).alias("mean_value"), r(F.col("s"), 2).alias("sum_value"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))
