"""Density-based clustering over grid cells.

Cells are half as wide as ``eps``, so all core points of one cell belong to the
same cluster and the graph to connect has cells, not points, as its nodes.
Whether two cells touch is decided like a radius count: by whole child cells
where possible, by points only where few are involved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, one_row
from .common import q, row_index
from .neighbours import (PAIR_LIMIT, SPLIT, _cells, cell_pairs, distinct_points, place_in_pairs, point_span,
                         point_tests, radius_counts, split_pairs)

NOISE = -1


def _cell_edges(core: DataFrame, eps: float, pair_limit: int) -> DataFrame:
    """(u, v) pairs of cell names that hold core points within eps of each other."""
    reach, size = 2.0, eps / 2.0
    probe, points = core.select("y", "x"), core.select("y", "x", F.lit(1).cast("long").alias("n"))
    pairs = (cell_pairs(probe, points, size, reach).where("ay < by or (ay = by and ax < bx)")
             .withColumns({"u": F.concat_ws("_", "ay", "ax"), "v": F.concat_ws("_", "by", "bx")}))
    found = None
    for _ in range(16):
        pairs = materialize(pairs, "db-pairs")
        crowded = F.col("na") * F.col("nb") > pair_limit
        cut = pairs.where("not inside")
        tests = cut.where(~crowded).select("u", "v", "ay", "ax", "by", "bx")
        step = pairs.where("inside").select("u", "v").unionAll(
            point_tests(place_in_pairs(tests, probe, size), points, size, eps, True).select("u", "v"))
        if found is not None:
            step = step.unionAll(found)
        found = materialize(step.distinct(), "db-edges")
        if cut.where(crowded).isEmpty():
            return found
        rest = cut.where(crowded).join(found, ["u", "v"], "left_anti")
        pairs = split_pairs(rest, probe, points, size, reach, ("u", "v"))
        size, reach = size / SPLIT, reach * SPLIT
    raise RuntimeError("points could not be separated; coordinates must be finite")


BLOCK = 32  # cells per side of a block


def _block_roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components within one block of cells: (node, local_root), root = least name."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in zip(pdf["u"], pdf["v"]):
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return pd.DataFrame({"node": list(parent), "local_root": [find(x) for x in parent]})


def cell_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for cells named ``cy_cx``.

    Edges inside a block of 32 x 32 cells are solved in one group each: such a
    group has at most 1024 nodes whatever the data.  What is left is a graph of
    block components, far smaller and with short paths.
    """
    def block(c: str):
        part = F.split(F.col(c), "_")
        return F.concat_ws("_", *[F.floor(part[i].cast("long") / BLOCK).cast("string") for i in (0, 1)])

    e = edges.withColumns({"bu": block("u"), "bv": block("v")})
    local = e.where("bu = bv").groupBy("bu").applyInPandas(_block_roots, "node string, local_root string")
    local = materialize(nodes.join(local, "node", "left").select("node", F.coalesce("local_root", "node").alias("local_root")), "cc-local")

    def to_root(df: DataFrame, c: str) -> DataFrame:
        return df.join(local.select(F.col("node").alias(c), F.col("local_root").alias("r" + c)), c)

    across = to_root(to_root(e.where("bu <> bv").select("u", "v"), "u"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    across = materialize(across.where("u <> v").distinct(), "cc-across")
    tops = local.select(F.col("local_root").alias("node")).distinct()
    roots = tops.select("node", F.col("node").alias("root")) if across.isEmpty() else connected_components(tops, across)
    return local.join(roots.withColumnRenamed("node", "local_root"), "local_root").select("node", "root")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) with root the least node name of the component.

    Each round takes the least label around a node and then jumps to the label's
    own label, which halves the distance to the root.  Every round is written to
    the shared folder, which keeps the plan short and survives lost executors.
    """
    both = materialize(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-edges")
    label = materialize(nodes.select("node", F.col("node").alias("root")), "cc-label")
    for _ in range(max_rounds):
        around = (both.join(label.select(F.col("node").alias("v"), "root"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near_root")))
        lower = label.join(around, "node", "left").select(
            "node", F.least("root", F.coalesce("near_root", "root")).alias("root"), F.col("root").alias("old"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far_root"))
        nxt = materialize(lower.join(jump, "root").select("node", F.col("far_root").alias("root"), "old"), "cc-label")
        changed = one_row(nxt.agg(F.count_if(F.col("root") != F.col("old")).alias("n")))["n"]
        label = nxt.select("node", "root")
        if not changed:
            return label
    raise RuntimeError("component search did not settle")


def _border(rim: DataFrame, core: DataFrame, owner: DataFrame, eps: float, pair_limit: int) -> DataFrame:
    """(y, x, cluster): the lowest-numbered cluster in reach of each place of ``rim`` that has one.

    Decided like a radius count, with a cell's cluster in place of its size: a pair of cells that lies wholly in reach
    labels the whole rim cell, a core cell wholly in reach of a place labels that place, and only what the circle cuts
    comes to point tests.  Crowded pairs are split, so no key holds all core places of a crowded cell.
    """
    reach, size = 2.0, eps / 2.0
    probe, points = rim.select("y", "x"), core.select("y", "x", F.lit(1).cast("long").alias("n"))
    owner = owner.withColumnsRenamed({"cy": "by", "cx": "bx"})
    pairs = cell_pairs(probe, points, size, reach).join(owner, ["by", "bx"])
    parts: list[DataFrame] = []
    for _ in range(16):
        pairs = materialize(pairs, "db-rim")
        whole = pairs.where("inside").groupBy("ay", "ax").agg(F.min("cluster").alias("cluster"))
        parts.append(_cells(probe, size, "a").join(whole, ["ay", "ax"]).select("y", "x", "cluster"))
        cut = pairs.where("not inside")
        crowded = F.col("na") * F.col("nb") > pair_limit
        placed = place_in_pairs(cut.where(~crowded).select("ay", "ax", "by", "bx", "cluster"), probe, size)
        p_in, p_out = point_span(size, eps)
        tests = placed.where(~p_in & ~p_out).select("py", "px", "by", "bx", "cluster")
        for found in (placed.where(p_in), point_tests(tests, points, size, eps, True)):
            parts.append(found.groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.min("cluster").alias("cluster")))
        if cut.where(crowded).isEmpty():
            return reduce(DataFrame.unionByName, parts).groupBy("y", "x").agg(F.min("cluster").alias("cluster"))
        pairs = split_pairs(cut.where(crowded), probe, points, size, reach, ("cluster",))
        size, reach = size / SPLIT, reach * SPLIT
    raise RuntimeError("points could not be separated; coordinates must be finite")


def dbscan_places(df: DataFrame, eps: float, min_samples: int, lat: str = "latitude", lon: str = "longitude",
                  pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(y, x, n, is_core, cluster) per distinct place; noise is -1.

    The neighbourhood is closed and counts the point itself.  Clusters are
    numbered by their southernmost, then westernmost core cell.  A border place
    joins the lowest-numbered cluster in reach.
    """
    pts = materialize(distinct_points(df, lat, lon), "db-points")
    counts = radius_counts(pts, pts, eps, True, pair_limit)
    flagged = materialize(
        pts.join(counts, ["y", "x"]).select("y", "x", "n", (F.col("hits") >= min_samples).alias("is_core")), "db-core")
    core = _cells(flagged.where("is_core").select("y", "x"), eps / 2.0, "c")
    cells = materialize(core.groupBy("cy", "cx").agg(F.count("*").alias("k"))
                        .withColumn("node", F.concat_ws("_", "cy", "cx")), "db-cells")
    roots = cell_components(cells.select("node"), _cell_edges(flagged.where("is_core"), eps, pair_limit))
    named = materialize(cells.join(roots, "node"), "db-roots")
    first = named.groupBy("root").agg(F.min(F.struct("cy", "cx")).alias("s")).select("root", "s.cy", "s.cx")
    number = row_index(first, ["cy", "cx"], "cluster").select("root", "cluster")
    cell_cluster = materialize(named.join(number, "root").select("cy", "cx", "cluster"), "db-cell-cluster")
    core = core.join(cell_cluster, ["cy", "cx"])
    border = _border(flagged.where("not is_core"), flagged.where("is_core"), cell_cluster, eps, pair_limit)
    labels = core.select("y", "x", "cluster").unionByName(border)
    return flagged.join(labels, ["y", "x"], "left").select(
        "y", "x", "n", "is_core", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))


def dbscan(df: DataFrame, eps: float, min_samples: int, lat: str = "latitude", lon: str = "longitude",
           pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Rows with their ``cluster``; rows without a place get NULL."""
    places = dbscan_places(df, eps, min_samples, lat, lon, pair_limit)
    per = materialize(places.select(F.col("y").alias(lat), F.col("x").alias(lon), "cluster"), "db-labels")
    return df.join(per, [lat, lon], "left").select(*df.columns, "cluster")


def dbscan_scaled(df: DataFrame, columns: Sequence[str] = ("latitude", "longitude"), eps: float = 0.1,
                  min_samples: int = 5, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Rows with their ``cluster`` by the distance of two standardised columns (mean 0, population deviation 1).

    Rows with a null in a column get NULL.  A column without spread is only shifted.
    """
    from .cluster import _scale

    a, b = ((q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in _scale(df, columns, True).items())
    z = df.withColumns({"_zy": a, "_zx": b})
    return dbscan(z, eps, min_samples, "_zy", "_zx", pair_limit).drop("_zy", "_zx")


def dbscan_report(labelled: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Per cluster, noise (-1) included: rows, share, mean and deviation of the columns; rows without a label are left out."""
    per = [x for c in columns for x in (F.avg(q(c)).alias(f"{c}_mean"), F.stddev_samp(q(c)).alias(f"{c}_std"))]
    known = labelled.where(q(label).isNotNull())
    stats = known.groupBy(label).agg(F.count("*").alias("n"), *per)
    share = F.col("n") * F.lit(100.0) / known.agg(F.count("*")).scalar()
    return stats.withColumn("share_pct", share)
