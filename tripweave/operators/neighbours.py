"""Exact counts of points within a radius, by two-sided grid refinement.

Testing all pairs of points is quadratic, and a grid join is still quadratic
inside a crowded cell.  Here pairs of *cells* are classified first.  A pair
that lies wholly within the radius adds its count without looking at points; a
pair that lies wholly outside is dropped.  Only pairs cut by the circle remain.
Those with few points are tested point by point; crowded ones are split into
smaller cells and classified again, until none is crowded.  So no task ever
holds a product of two large groups, however the points are concentrated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import in_parallel, materialize, small_side, spread

PAIR_LIMIT = 20_000
SPLIT = 4  # a cell splits into SPLIT x SPLIT children
_MAX_LEVELS = 16


def distinct_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(y, x, n): equal coordinates merged, missing ones left out."""
    return (df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .groupBy(F.col(lat).alias("y"), F.col(lon).alias("x")).agg(F.count("*").alias("n")))


def _cells(points: DataFrame, size: float, tag: str) -> DataFrame:
    return points.withColumns({
        f"{tag}y": F.floor(F.col("y") / F.lit(size)), f"{tag}x": F.floor(F.col("x") / F.lit(size))})


def _span(dy: Column, dx: Column, reach: float) -> tuple[Column, Column]:
    """(wholly inside, wholly outside) for cells that lie dy, dx apart; reach = radius / cell size.

    A relative margin keeps pairs near the limit for the exact point test.
    """
    ay, ax = F.abs(dy).cast("double"), F.abs(dx).cast("double")
    far = (ay + 1) * (ay + 1) + (ax + 1) * (ax + 1)
    ny, nx = F.greatest(ay - 1, F.lit(0.0)), F.greatest(ax - 1, F.lit(0.0))
    near = ny * ny + nx * nx
    return far < reach * reach * (1 - 1e-9), near > reach * reach * (1 + 1e-9)


def around(cells: DataFrame, y: str, x: str, to_y: str, to_x: str, reach: float) -> DataFrame:
    """Every cell with the cells that are not wholly out of reach; ``inside`` marks those wholly in reach."""
    k = int(reach) + 1
    big = (cells.withColumn(to_y, F.explode(F.sequence(F.col(y) - k, F.col(y) + k)))
           .withColumn(to_x, F.explode(F.sequence(F.col(x) - k, F.col(x) + k))))
    inside, outside = _span(F.col(y) - F.col(to_y), F.col(x) - F.col(to_x), reach)
    return big.where(~outside).withColumn("inside", inside)


def near(y1: Column, x1: Column, y2: Column, x2: Column, radius: float, inclusive: bool) -> Column:
    dy, dx = y1 - y2, x1 - x2
    dist = F.sqrt(dy * dy + dx * dx)
    return dist <= F.lit(radius) if inclusive else dist < F.lit(radius)


def cell_pairs(probe: DataFrame, points: DataFrame, size: float, reach: float) -> DataFrame:
    """Occupied cells of both sides that lie close enough to matter."""
    ac = _cells(probe, size, "a").groupBy("ay", "ax").agg(F.count("*").alias("na"))
    bc = _cells(points, size, "b").groupBy("by", "bx").agg(F.count("*").alias("nb"), F.sum("n").alias("wb"))
    return around(spread(ac, "ay", "ax"), "ay", "ax", "by", "bx", reach).join(
        small_side(materialize(bc, "nb-cells")), ["by", "bx"])


def point_tests(tests: DataFrame, points: DataFrame, size: float, radius: float,
                inclusive: bool) -> DataFrame:
    """Pairs of points (py, px) - (y, x, n) within the radius, for the given pairs of cells.

    A pair of cells stands for at most ``pair_limit`` tests, so no join key is heavy.
    """
    b = _cells(points, size, "b").select("by", "bx", "y", "x", "n")
    return tests.join(b, ["by", "bx"]).where(near(F.col("py"), F.col("px"), F.col("y"), F.col("x"), radius, inclusive))


def place_in_pairs(pairs: DataFrame, probe: DataFrame, size: float) -> DataFrame:
    """Pairs of cells with the probe points (py, px) of their first cell."""
    a = _cells(probe, size, "a").select("ay", "ax", F.col("y").alias("py"), F.col("x").alias("px"))
    return pairs.join(a, ["ay", "ax"])


def point_span(size: float, radius: float) -> tuple[Column, Column]:
    """(wholly inside, wholly outside) for the cell by, bx seen from the point py, px."""
    def ends(p: str, c: str) -> tuple[Column, Column]:
        lo = F.col(c).cast("double") * F.lit(size)
        a, b = F.col(p) - lo, lo + F.lit(size) - F.col(p)
        return F.greatest(a, b), F.greatest(-a, -b, F.lit(0.0))

    fy, ny = ends("py", "by")
    fx, nx = ends("px", "bx")
    sq = radius * radius
    return fy * fy + fx * fx < sq * (1 - 1e-7), ny * ny + nx * nx > sq * (1 + 1e-7)


def split_pairs(cut: DataFrame, probe: DataFrame, points: DataFrame, size: float, reach: float,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace crowded pairs of cells by the pairs of their children."""
    def children(pts: DataFrame, tag: str, *aggs) -> DataFrame:
        both = _cells(_cells(pts, size, "p" + tag), size / SPLIT, tag)
        return both.groupBy(f"p{tag}y", f"p{tag}x", f"{tag}y", f"{tag}x").agg(*aggs)

    ca = children(probe, "a", F.count("*").alias("na"))
    cb = children(points, "b", F.count("*").alias("nb"), F.sum("n").alias("wb"))
    old = cut.select(F.col("ay").alias("pay"), F.col("ax").alias("pax"), F.col("by").alias("pby"),
                     F.col("bx").alias("pbx"), *keep)
    inside, outside = _span(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"), reach * SPLIT)
    ca, cb = small_side(materialize(ca, "nb-children")), small_side(materialize(cb, "nb-children"))
    return (spread(old, "pay", "pax", "pby", "pbx").join(ca, ["pay", "pax"]).join(cb, ["pby", "pbx"]).where(~outside)
            .select("ay", "ax", "na", "by", "bx", inside.alias("inside"), "nb", "wb", *keep))


def radius_counts(probe: DataFrame, points: DataFrame, radius: float, inclusive: bool = False,
                  pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(y, x, hits) for every distinct probe coordinate.

    ``probe`` holds distinct (y, x); ``points`` holds distinct (y, x) and their
    number n.  Both are read several times, so pass written tables.  ``hits`` is
    the summed n within the radius, the probe's own coordinate included when it
    is among the points.
    """
    reach = 4.0
    size = radius / reach
    parts: list[DataFrame] = []  # (y, x, hits) contributions
    pairs = cell_pairs(probe, points, size, reach)
    for _ in range(_MAX_LEVELS):
        pairs = materialize(pairs, "nb-pairs")
        whole = pairs.where("inside").groupBy("ay", "ax").agg(F.sum("wb").alias("hits"))
        parts.append(_cells(probe, size, "a").join(whole, ["ay", "ax"]).select("y", "x", "hits"))
        cut = pairs.where("not inside")
        crowded = F.col("na") * F.col("nb") > pair_limit
        # seen from a single point, most of the cut cells are wholly in or out
        placed = place_in_pairs(cut.where(~crowded).select("ay", "ax", "by", "bx", "wb"), probe, size)
        p_in, p_out = point_span(size, radius)
        hit = point_tests(placed.where(~p_in & ~p_out).select("py", "px", "by", "bx"), points, size, radius, inclusive)
        for found, w in ((placed.where(p_in), "wb"), (hit, "n")):
            parts.append(found.groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum(w).alias("hits")))
        if cut.where(crowded).isEmpty():
            break
        pairs = split_pairs(cut.where(crowded), probe, points, size, reach)
        size, reach = size / SPLIT, reach * SPLIT
    else:
        raise RuntimeError("points could not be separated; coordinates must be finite")
    total = parts[0]
    for p in parts[1:]:
        total = total.unionAll(p)
    sums = total.groupBy("y", "x").agg(F.sum("hits").alias("hits"))
    return probe.select("y", "x").join(sums, ["y", "x"], "left").select(
        "y", "x", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def density_features(df: DataFrame, radii: dict[str, float], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """For every row the number of other rows closer than each radius (NULL without a place)."""
    pts = materialize(distinct_points(df, lat, lon), "nb-distinct")
    counts = in_parallel(lambda radius: radius_counts(pts, pts, radius), radii.values())
    # counts of all radii are stacked and summed up in one aggregate
    found = reduce(DataFrame.unionAll, [
        c.select("y", "x", F.lit(name).alias("k"), (F.col("hits") - 1).alias("h")) for name, c in zip(radii, counts)])
    per_place = found.groupBy("y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("h"))).alias(k) for k in radii])
    per_place = materialize(per_place, "nb-density").withColumnsRenamed({"y": lat, "x": lon})
    return df.join(per_place, [lat, lon], "left").select(*df.columns, *radii)
