"""k-means and hierarchical clustering, quality indices, cluster statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import cyclic_pair
from ..functions.numbers import r, ratio
from ..session import materialize, one_row, small_side, spread_rows
from .common import q, tidy_stats

SEED = 42


def place_features(df: DataFrame, time: str | None = None, weight: str | None = None,
                   lat: str = "latitude", lon: str = "longitude") -> tuple[DataFrame, list[str]]:
    """Numeric clustering inputs: place, and on request time of day and weight."""
    df = df.where(F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0))
    cols = [lat, lon]
    if time:
        s, c = cyclic_pair(F.hour(time), 24)
        df = df.withColumns({"hour_sin": s, "hour_cos": c})
        cols += ["hour_sin", "hour_cos"]
    if weight:
        cols.append(weight)
    return df, cols


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_z`` with the population standard deviation; a constant column becomes 0."""
    s = one_row(df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]))
    return df.withColumns({
        f"{c}_z": (F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, c in enumerate(cols)})


def _seeds(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with the square of its distance to those drawn before."""
    out = [rows[rng.integers(len(rows))]]
    gap = ((rows - out[0]) ** 2).sum(1)
    while len(out) < k and gap.sum() > 0:
        out.append(rows[rng.choice(len(rows), p=gap / gap.sum())])
        gap = np.minimum(gap, ((rows - out[-1]) ** 2).sum(1))
    return np.array(out)


def _settle(rows: np.ndarray, weight: np.ndarray, centers: np.ndarray, limit: float, turns: int) -> np.ndarray:
    """The centres after some rounds among a few weighted rows."""
    shift = np.average(rows, 0, weight)
    rows, centers = rows - shift, centers - shift
    for _ in range(turns):
        near = ((centers * centers).sum(1) - 2 * rows @ centers.T).argmin(1)
        n = np.bincount(near, weight, len(centers))
        total = np.stack([np.bincount(near, x * weight, len(centers)) for x in rows.T], 1)
        new = np.where(n[:, None] > 0, total / np.where(n > 0, n, 1)[:, None], centers)
        moved, centers = ((new - centers) ** 2).sum(), new
        if moved <= limit:
            break
    return centers + shift


def _cells(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and number of the rows of each cell of a grid of at most CELLS cells over all rows."""
    cols = base.columns
    bins = max(int(CELLS ** (1 / len(cols)) + 1e-9), 1)
    ends = one_row(base.agg(*[f(c).alias(f"{n}{c}") for c in cols for n, f in (("lo_", F.min), ("hi_", F.max))]))
    at = [F.least(F.floor((F.col(c) - ends[f"lo_{c}"]) / ((ends[f"hi_{c}"] - ends[f"lo_{c}"]) / bins or 1.0)), F.lit(bins - 1)).alias(f"c_{c}") for c in cols]
    found = base.groupBy(*at).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols]).toPandas()  # at most CELLS rows
    return found[cols].to_numpy(), found["n"].to_numpy(float)


def _settled(base: DataFrame, some: np.ndarray, jobs: list[tuple[int, np.ndarray]], limit: float) -> dict[int, np.ndarray]:
    """Centres of every start, settled among some rows and then among the cells of all rows, a start to a task.

    Starts of one k that end within ``limit`` of each other have found the same centres, and one of them goes on.
    """
    sc = base.sparkSession.sparkContext
    shared = sc.broadcast((some, *_cells(base), jobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, cells, weight, jobs = shared.value
        for b in batches:
            for j in b.column(0).to_pylist():
                c = _settle(some, np.ones(len(some)), jobs[j][1], limit / 100, 40)
                c = _settle(cells, weight, c, limit / 100, 200)
                c = c[np.lexsort(c.T[::-1])]
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([c.ravel().tolist()], pa.list_(pa.float64()))], ["j", "c"])

    found = base.sparkSession.range(len(jobs), numPartitions=min(len(jobs), 2 * sc.defaultParallelism)).mapInArrow(run, "j bigint, c array<double>").collect()  # a row per start
    out: dict[int, np.ndarray] = {}
    for j, c in sorted((x["j"], np.array(x["c"]).reshape(-1, some.shape[1])) for x in found):
        if not any(jobs[i][0] == jobs[j][0] and d.shape == c.shape and ((d - c) ** 2).sum() <= limit for i, d in out.items()):
            out[j] = c
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that their distances to all centres stay small."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _pass(base: DataFrame, jobs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per job the sizes, sums and costs of its clusters, for all jobs in one scan; a task sends a row per job and cluster."""
    dims = len(base.columns)
    every = np.concatenate(list(jobs.values()))
    shift = every.mean(0)  # squares of small numbers lose fewer digits
    every = every - shift
    spans = np.cumsum([0, *[len(c) for c in jobs.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {j: np.zeros((len(c), dims + 2)) for j, c in jobs.items()}
        for b in _slices(batches):
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(dims)]) - shift
            gaps = (every * every).sum(1) - 2 * rows @ every.T  # less the row's own square, which is the same for all centres
            own, at = np.einsum("ij,ij->i", rows, rows), np.arange(len(rows))
            for j, lo, hi in zip(jobs, spans, spans[1:]):
                near = gaps[:, lo:hi].argmin(1)
                gap = np.maximum(gaps[at, lo + near] + own, 0)
                for i, w in enumerate([None, gap, *(rows + shift).T]):
                    sums[j][:, i] += np.bincount(near, w, hi - lo)
        cells = [(j, c, *row) for j, table in sums.items() for c, row in enumerate(table)]
        cols = list(zip(*cells)) if cells else [[]] * (dims + 4)
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * (dims + 2)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names)

    names = ["job", "c", "n", "cost", *[f"s{i}" for i in range(dims)]]
    out = base.mapInArrow(run, "job int, c int, " + ", ".join(f"{n} double" for n in names[2:]))
    out = out.groupBy("job", "c").agg(*[F.sum(n).alias(n) for n in names[2:]]).toPandas()  # a row per job and cluster
    found = {}
    for j, g in out.sort_values(["job", "c"]).groupby("job"):
        found[int(j)] = (g["n"].to_numpy(), g[names[4:]].to_numpy(), g["cost"].to_numpy())
    return found


STARTS, SAMPLE = 10, 4_096  # k-means: starts, and the rows from which first centres are drawn
CELLS = 1 << 14  # cells of the grid that stands for all rows until centres have settled


def fit_centers(base: DataFrame, ks: Sequence[int], starts: int = STARTS, seed: int = SEED, passes: int = 100,
                tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost of the best of several starts for every k; ``base`` has the numeric inputs alone.

    All starts of all k move together, one scan a pass; a start is done when its centres move by less than ``tol`` of the
    mean variance.  First centres are drawn from SAMPLE rows in the order of a hash and settled among these and then among the
    means of at most CELLS cells of all rows, which spares most passes; from there on every pass and every cost covers all rows.
    Rows with nulls are left out; without rows there are no centres.
    """
    cols = base.columns
    base = base.dropna().select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    some = base.orderBy(F.xxhash64(*base.columns), *base.columns).limit(SAMPLE).toPandas().to_numpy()
    if not len(some):
        return {k: (np.zeros((0, len(cols))), 0.0) for k in ks}
    rng = np.random.default_rng(seed)
    jobs = [(k, _seeds(some, k, rng)) for k in ks for _ in range(starts)]
    limit = tol * float(some.var(0).mean())
    live, best = _settled(base, some, jobs, limit), {}
    for turn in range(passes + 1):
        for j, (n, total, costs) in _pass(base, live).items():
            old, k, cost = live[j], jobs[j][0], float(costs.sum())
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
            if ((new - old) ** 2).sum() <= limit or turn == passes:
                del live[j]
                if k not in best or cost < best[k][1]:
                    best[k] = (old, cost)
            else:
                live[j] = new
        if not live:
            break
    return best


def nearest(values: Sequence[Column], centers: np.ndarray) -> Column:
    """Number of the nearest centre, the lower one of two; null where a value is null."""
    if not len(centers):
        return F.lit(None).cast("int")
    gaps = F.array(*[sum(((v - F.lit(float(x))) * (v - F.lit(float(x))) for v, x in zip(values, c)), F.lit(0.0)) for c in centers])
    # without a value all gaps are null, and so is the number
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def _scale(df: DataFrame, cols: Sequence[str], scaled: bool) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, or (0, 1)."""
    if not scaled:
        return {c: (0.0, 1.0) for c in cols}
    s = one_row(df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]))
    return {c: (s[f"m{i}"] or 0.0, s[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def _bisecting(df: DataFrame, cols: Sequence[str], k: int, seed: int) -> np.ndarray:
    rows = spread_rows(df.select(*cols))  # kept in memory by tasks, whatever the files were packed to
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_vec").fit(VectorAssembler(inputCols=list(cols), outputCol="_vec").transform(rows))
    return np.array([list(c) for c in model.clusterCenters()])


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 8, scaled: bool = True, seed: int = SEED, name: str = "cluster",
           algorithm: str = "kmeans", starts: int = STARTS) -> DataFrame:
    """Rows with their cluster, numbered by the order of the centres (south to north); null where an input is null.

    ``algorithm`` is kmeans (the best of ``starts``) or bisecting.
    """
    scale = _scale(df, cols, scaled)
    z = {c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()}
    base = materialize(spread_rows(df.select(*[z[c].alias(f"z{i}") for i, c in enumerate(cols)])), "kmeans")
    centers = fit_centers(base, [k], starts, seed)[k][0] if algorithm == "kmeans" else _bisecting(base.dropna(), base.columns, k, seed)
    return df.withColumn(name, nearest([z[c] for c in cols], centers[np.lexsort(centers.T[::-1])]))


def cluster_columns(df: DataFrame, sizes: Sequence[int] = (5, 8, 10), lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One k-means label column per size, on raw degrees; all sizes are fitted together."""
    base = materialize(spread_rows(df.select(lat, lon)), "cluster-input")
    found = fit_centers(base, sizes)
    return df.withColumns({f"cluster_{k}": nearest([q(lat), q(lon)], c[np.lexsort(c.T[::-1])]) for k, (c, _) in found.items()})


def cluster_stats(df: DataFrame, label: str = "cluster", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Size, share, centre and mean distance to the centre; noise (-1) is left out of centres.

    The mean distance needs the centre first: two aggregates over the labelled rows.
    """
    from .common import attach

    total = df.agg(F.count("*").alias("n")).scalar()
    centers = df.groupBy(label).agg(F.count("*").alias("size"), F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))
    j = attach(df.select(label, lat, lon), centers, [label])
    dy, dx = F.col(lat) - F.col("center_lat"), F.col(lon) - F.col("center_lon")
    return (j.groupBy(label).agg(
        F.first("size").alias("size"), F.first("center_lat").alias("center_lat"), F.first("center_lon").alias("center_lon"),
        F.avg(F.sqrt(dy * dy + dx * dx)).alias("radius"))
        .select(label, "size", r(ratio(F.col("size"), total) * 100).alias("share_pct"), r(F.col("center_lat")).alias("center_lat"),
                r(F.col("center_lon")).alias("center_lon"), r(F.col("radius")).alias("radius")))


def cluster_profile(df: DataFrame, label: str = "cluster", weight: str | None = None,
                    lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    aggs = [F.count("*").alias("size"), r(F.avg(lat)).alias("lat_mean"), r(F.stddev_samp(lat)).alias("lat_std"),
            r(F.avg(lon)).alias("lon_mean"), r(F.stddev_samp(lon)).alias("lon_std")]
    if weight:
        aggs += [r(F.avg(weight)).alias("demand_mean"), r(F.stddev_samp(weight)).alias("demand_std"),
                 r(F.sum(weight), 4).alias("demand_sum")]
    return df.where(F.col(label) != -1).groupBy(label).agg(*aggs)


PER_BLOCK = 1_024  # clusters whose figures one row of a block table holds


def _in_blocks(figures: DataFrame, fields: Sequence[Column], clusters: int) -> tuple[DataFrame, int]:
    """Figures per cluster ``k`` gathered in blocks of about PER_BLOCK: (block, cs), and the number of blocks."""
    n = -(-clusters // PER_BLOCK)
    block = F.pmod(F.xxhash64("k"), F.lit(n)).alias("block")
    packed = figures.select(block, F.struct(F.col("k").alias("t"), *fields).alias("c")).groupBy("block")
    return materialize(packed.agg(F.sort_array(F.collect_list("c")).alias("cs")), "cq-blocks"), n


def _meet(rows: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Every row with every block of clusters; a few blocks are broadcast, more are joined by shuffle."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return rows.withColumn("block", F.explode(every)).join(small_side(blocks, 256), "block")


def quality_indices(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """One row: clusters, silhouette (squared distance), Calinski-Harabasz, Davies-Bouldin.

    Noise is left out.  The silhouette of squared distances and the other two
    indices follow from per-cluster counts and sums: a point is compared with
    cluster sums, never with other points.  The sums are dealt in blocks of bounded
    size that rows meet in a join, so neither the driver nor a row ever holds all
    clusters.  Fewer than two clusters give zeros.
    """
    dims = range(len(cols))
    x = [f"x{i}" for i in dims]
    d = df.where(q(label) >= 0).select(q(label).alias("k"), *[q(c).cast("double").alias(n) for c, n in zip(cols, x)])

    def total(parts) -> Column:
        return sum(parts, F.lit(0.0))

    sums = materialize(d.groupBy("k").agg(
        F.count("*").cast("double").alias("n"), F.sum(total(F.col(c) * F.col(c) for c in x)).alias("ss"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]), "cq-sums")
    clusters = sums.count()
    spark = d.sparkSession
    if clusters < 2:
        return spark.range(1).select(F.lit(clusters).cast("long").alias("clusters"), F.lit(0.0).alias("silhouette"),
                                     F.lit(0.0).alias("calinski_harabasz"), F.lit(0.0).alias("davies_bouldin"))
    mids = [F.col(f"m{i}") for i in dims]
    # mean squared distance of a point to the rows of t is |x - m|^2 + spread of t
    blocks, n = _in_blocks(sums, [F.col("n"), (F.col("ss") / F.col("n") - total(m * m for m in mids)).alias("spread"), *mids], clusters)
    unknown = F.lit(None).cast("double")

    def compare(best, t):
        """Smallest distance to another cluster so far, distance to the own one and its centre."""
        gap = total((F.col(c) - t[f"m{i}"]) * (F.col(c) - t[f"m{i}"]) for i, c in enumerate(x))
        mine = t["t"] == F.col("k")
        own = F.when(t["n"] > 1, (gap + t["spread"]) * t["n"] / (t["n"] - 1))
        return F.struct(F.when(mine, best["oth"]).otherwise(F.least(best["oth"], gap + t["spread"])).alias("oth"),
                        F.when(mine, own).otherwise(best["own"]).alias("own"), F.when(mine, gap).otherwise(best["w"]).alias("w"))

    first = F.struct(unknown.alias("oth"), unknown.alias("own"), unknown.alias("w"))
    if n == 1:
        pts = _meet(d, blocks, n).select("k", F.aggregate("cs", first, compare).alias("f")).select("k", "f.*")
    else:
        named = materialize(d.withColumn("id", F.monotonically_increasing_id()), "cq-rows")  # written: the numbers stand
        pts = _meet(named, blocks, n).select("id", "k", F.aggregate("cs", first, compare).alias("f")).groupBy("id", "k").agg(
            F.min("f.oth").alias("oth"), F.max("f.own").alias("own"), F.max("f.w").alias("w"))
    # a cluster of one row has no own distance: its silhouette is 0
    s = F.coalesce(F.try_divide(F.col("oth") - F.col("own"), F.greatest("own", "oth")), F.lit(0.0))
    per = pts.select("k", s.alias("s"), "w").groupBy("k").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.avg(F.sqrt("w")).alias("dist"))
    per = materialize(per.join(sums, "k"), "cq-per")
    blocks, n = _in_blocks(per, [F.col("dist"), *mids], clusters)

    def worse(best, t):
        gap = F.sqrt(total((m - t[f"m{i}"]) * (m - t[f"m{i}"]) for i, m in enumerate(mids)))
        return F.greatest(best, F.when((t["t"] != F.col("k")) & (gap > 0), (F.col("dist") + t["dist"]) / gap).otherwise(F.lit(0.0)))

    worst = (_meet(per.select("k", "dist", *mids), blocks, n).select("k", F.aggregate("cs", F.lit(0.0), worse).alias("v"))
             .groupBy("k").agg(F.max("v").alias("v")).agg(F.avg("v")).scalar())
    mean = one_row(per.agg(*[(F.sum(F.col("n") * m) / F.sum("n")).alias(f"g{i}") for i, m in enumerate(mids)]))
    between = F.sum(F.col("n") * total((m - F.lit(mean[f"g{i}"])) * (m - F.lit(mean[f"g{i}"])) for i, m in enumerate(mids)))
    rows, k = F.sum("n"), F.lit(float(clusters))
    ch = F.when((F.sum("w") > 0) & (rows > k), (between / (k - 1)) / (F.sum("w") / (rows - k))).otherwise(F.lit(1.0))
    return per.agg(F.lit(clusters).cast("long").alias("clusters"), (F.sum("s") / rows).alias("silhouette"),
                   ch.alias("calinski_harabasz")).withColumn("davies_bouldin", worst)


def _silhouettes(base: DataFrame, jobs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per job a table (sum of silhouettes, of squared distances, of distances to the own mean), a row per cluster.

    ``jobs`` has the centres that deal out the rows, and the means and spreads of the clusters; one scan for all jobs.
    """
    dims = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {j: np.zeros((len(c), 3)) for j, (c, *_) in jobs.items()}
        for b in _slices(batches):
            rows, at = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(dims)]), np.arange(b.num_rows)
            for j, (centers, size, mids, spread) in jobs.items():
                shift = centers.mean(0)
                x, c, m = rows - shift, centers - shift, mids - shift
                near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
                gap = np.maximum((m * m).sum(1) - 2 * x @ m.T + np.einsum("ij,ij->i", x, x)[:, None], 0)
                w, far = gap[at, near], gap + spread
                n = size[near]
                own = far[at, near] * n / np.maximum(n - 1, 1)
                far[:, size == 0] = np.inf
                far[at, near] = np.inf
                other = far.min(1)
                top = np.maximum(own, other)
                s = np.where((n > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0)
                for i, v in enumerate((s, w, np.sqrt(w))):
                    sums[j][:, i] += np.bincount(near, v, len(centers))
        cells = [(j, c, *row) for j, table in sums.items() for c, row in enumerate(table)]
        cols = list(zip(*cells)) if cells else [[]] * 5
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], ["job", "c", "s", "w", "d"])

    out = base.mapInArrow(run, "job int, c int, s double, w double, d double").groupBy("job", "c").agg(
        F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("d").alias("d")).toPandas()  # a row per job and cluster
    return {int(j): g[["s", "w", "d"]].to_numpy() for j, g in out.sort_values(["job", "c"]).groupby("job")}


def indices_of_centers(base: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[int, float, float, float]]:
    """(clusters, silhouette, Calinski-Harabasz, Davies-Bouldin) of several clusterings of ``base`` by nearest centre.

    The figures of ``quality_indices``, for all clusterings together in two scans; few clusters each, numeric columns alone.
    """
    base = base.dropna()
    out = {j: (0, 0.0, 0.0, 0.0) for j in centers}
    first = {j: x for j, x in _pass(base, {j: c for j, c in centers.items() if len(c)}).items()} if any(map(len, centers.values())) else {}
    jobs = {}
    for j, (n, total, cost) in first.items():
        size = np.where(n > 0, n, 1)
        mids = np.where(n[:, None] > 0, total / size[:, None], centers[j])
        spread = np.where(n > 0, np.maximum(cost / size - ((mids - centers[j]) ** 2).sum(1), 0), 0)
        out[j] = (int((n > 0).sum()), 0.0, 0.0, 0.0)
        if out[j][0] > 1:
            jobs[j] = (centers[j], n, mids, spread)
    for j, table in (_silhouettes(base, jobs) if jobs else {}).items():
        _, n, mids, _ = jobs[j]
        keep = n > 0
        n, mids, (s, w, d) = n[keep], mids[keep], table[keep].T
        rows, k = n.sum(), len(n)
        between = (n * ((mids - np.average(mids, 0, n)) ** 2).sum(1)).sum()
        ch = (between / (k - 1)) / (w.sum() / (rows - k)) if w.sum() > 0 and rows > k else 1.0
        gap = np.sqrt(((mids[:, None] - mids) ** 2).sum(2))
        near = d / n
        db = np.where(gap > 0, (near[:, None] + near) / np.where(gap > 0, gap, 1), 0.0).max(1).mean()
        out[j] = (k, float(s.sum() / rows), float(ch), float(db))
    return out


def k_scan(df: DataFrame, cols: Sequence[str], ks: Sequence[int], scaled: bool = True, seed: int = SEED, starts: int = STARTS) -> DataFrame:
    """Per k: inertia of the best of ``starts`` and the three indices, over one prepared input."""
    base = standardize(df, cols).select(*[f"{c}_z" for c in cols]) if scaled else df.select(*cols)
    base = base.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(base.columns)])
    base = materialize(spread_rows(base), "kscan")
    found = fit_centers(base, list(ks), starts, seed)
    figures = indices_of_centers(base, {k: c for k, (c, _) in found.items()})
    rows = [(k, found[k][1], *figures[k]) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, clusters bigint, silhouette double, calinski_harabasz double, davies_bouldin double")


def pick_k(scan: DataFrame, method: str) -> int:
    """Best k: highest silhouette or Calinski-Harabasz, lowest Davies-Bouldin, sharpest elbow."""
    rows = sorted((x.asDict() for x in scan.collect()), key=lambda x: x["k"])  # a row per tried k
    if method == "elbow":
        if len(rows) < 3:
            return rows[0]["k"]
        bend = [(rows[i - 1]["inertia"] - 2 * rows[i]["inertia"] + rows[i + 1]["inertia"], -rows[i]["k"])
                for i in range(1, len(rows) - 1)]
        return -max(bend)[1]
    sign = {"silhouette": -1, "calinski": -1, "davies": 1}[method]
    field = {"silhouette": "silhouette", "calinski": "calinski_harabasz", "davies": "davies_bouldin"}[method]
    return min(rows, key=lambda x: (sign * x[field], x["k"]))["k"]


def feature_scale_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every standardised column."""
    return tidy_stats(standardize(df, cols), [f"{c}_z" for c in cols],
                      {"mean": lambda c: r(F.avg(c), 4), "std": lambda c: r(F.stddev_pop(c), 4)})
