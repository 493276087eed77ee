"""Anomaly scores: distributed isolation forest and low-rank reconstruction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import r
from ..session import materialize, spread, spread_small
from .common import q
from .quantile import exact_quantiles

TREES, SAMPLE = 100, 256
_NODE = "tree int, node int, feature int, split double, left int, right int, path double"


def _mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """One isolation tree over a bounded sample, as rows of ``_NODE``."""
    rng = np.random.default_rng([seed, tree])
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    stack = [(0, np.arange(len(x)), 0)]
    used = 1
    while stack:
        node, idx, depth = stack.pop()
        part = x[idx]
        lo, hi = (part.min(axis=0), part.max(axis=0)) if len(idx) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(wide) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + _mean_path(len(idx))))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(lo[f], hi[f]))
        go_left = part[:, f] < cut
        nodes.append((tree, node, f, cut, used, used + 1, 0.0))
        stack += [(used, idx[go_left], depth + 1), (used + 1, idx[~go_left], depth + 1)]
        used += 2
    return nodes


def isolation_scores(df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = 42) -> DataFrame:
    """Rows with ``score`` in (0, 1); higher is more isolated.  NULL inputs take the median.

    Each tree sees ``sample`` rows, as the method prescribes, and grows in its own
    task.  The forest has at most trees x 2 x sample nodes whatever the data size,
    so it can be broadcast; scoring runs in Arrow batches where the rows are.
    """
    med = exact_quantiles(df, {c: [0.5] for c in columns})
    d = df.withColumns({f"_x{i}": F.coalesce(q(c).cast("double"), F.lit(med[c][0] if med[c][0] is not None else 0.0))
                        for i, c in enumerate(columns)})
    xs = [f"_x{i}" for i in range(len(columns))]
    # a pool that every tree can draw from without seeing all rows, and per tree a
    # thin share of the pool that holds several times the rows it needs
    total = df.count()
    share = min(1.0, 4.0 * trees * sample / max(total, 1))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), q(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    pool = spread(d.where(pick <= share).select(q(key).alias("_k"), *xs))
    draw = F.pmod(F.xxhash64(q("_k"), F.col("tree"), F.lit(seed)), F.lit(1 << 40))
    thin = min(1.0, 4.0 * sample / max(total * share, 1.0))
    draws = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", draw)
             .where(F.col("_h") <= F.lit(int(thin * (1 << 40)))))
    first = W.partitionBy("tree").orderBy("_h", "_k")
    drawn = draws.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample).select("tree", "_r", *xs)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        rows = _grow(pdf[xs].to_numpy(dtype=float), int(pdf["tree"].iloc[0]), seed)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "path"])

    grown = drawn.groupBy("tree").applyInPandas(grow, _NODE).toPandas()  # bounded by the forest's size
    forest = [g.sort_values("node")[["feature", "split", "left", "right", "path"]].to_numpy(dtype=float)
              for _, g in grown.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = _mean_path(min(sample, total)) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total_path = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in shared.value:
            feat, cut, left, right, path = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]
            at = np.zeros(len(x), dtype=int)
            live = feat[at] >= 0
            while live.any():
                i = rows[live]
                f = feat[at[i]]
                at[i] = np.where(x[i, f] < cut[at[i]], left[at[i]], right[at[i]])
                live = feat[at] >= 0
            total_path += path[at]
        return pd.Series(np.power(2.0, -total_path / len(shared.value) / norm))

    return spread_small(d, total).withColumn("score", score(*xs)).drop(*xs)


def isolation_flags(df: DataFrame, columns: Sequence[str], key: str, contamination: float = 0.05, **kw) -> DataFrame:
    """``score`` and ``is_anomaly``: the ``contamination`` share with the highest scores."""
    s = materialize(isolation_scores(df, columns, key, **kw), "iforest-scores")
    cut = exact_quantiles(s, {"score": [1.0 - contamination]})["score"][0]
    return s.withColumn("is_anomaly", (F.col("score") > F.lit(cut)).cast("int"))


def drop_isolated(df: DataFrame, columns: Sequence[str], key: str, contamination: float = 0.1, **kw) -> DataFrame:
    """Outlier removal: rows without the most isolated share."""
    return isolation_flags(df, columns, key, contamination, **kw).where("is_anomaly = 0").drop("score", "is_anomaly")


def reconstruction_errors(df: DataFrame, vector: str, components: int = 8, share: float = 0.95) -> DataFrame:
    """``error``: mean squared error of a row rebuilt from its first principal components;
    ``is_anomaly`` above the ``share`` quantile.

    With orthonormal components the lost part of a centred row is its squared norm
    minus that of its projection, so nothing is rebuilt.
    """
    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[
        StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False),
        PCA(k=components, inputCol="_c", outputCol="_p")]).fit(d)

    def norm2(c: str) -> Column:
        return F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda a, v: a + v * v)

    e = F.greatest((norm2("_c") - norm2("_p")) / F.size(F.col(vector)), F.lit(0.0))
    out = materialize(model.transform(d).withColumn("error", e).drop("_v", "_c", "_p"), "pca-errors")
    cut = exact_quantiles(out, {"error": [share]})["error"][0]
    return out.withColumn("is_anomaly", (F.col("error") > F.lit(cut)).cast("int")).withColumn("error", r(F.col("error")))
