"""Operators against brute force and hand-computed values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripweave.functions import calendar as cal
from tripweave.functions.geo import equal_width_bin, in_city
from tripweave.functions.numbers import human_number, normal_quantile
from tripweave.operators import chartdata, clean, cluster, common, dbscan, encode, explore, metrics, neighbours, quality, series
from tripweave.operators.quantile import exact_quantiles
from tripweave import session
from tripweave.session import materialize
from tripweave.sources import sampling


def points(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "event_id long, latitude double, longitude double")


# ---- quantiles, prefix sums, positions -------------------------------------------


def test_bracketed_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(size=1000) * 100])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x[::-1] * 2})).repartition(7)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"x": probs, "y": [0.3]}, direct_limit=50)
    assert np.allclose(got["x"], np.quantile(x, probs), atol=1e-12)
    assert np.allclose(got["y"], np.quantile(x * 2, [0.3]), atol=1e-12)
    assert exact_quantiles(df, {"x": probs}) == {"x": pytest.approx(got["x"])}


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}
    both = df.select("x", F.lit(1.0).alias("y"))
    assert exact_quantiles(both, {"x": [0.5], "y": [0.5]}, direct_limit=0) == {"x": [None], "y": [1.0]}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_prefix_sums_by_ranges(spark, parts):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("k"), (F.col("id") % 5).alias("v")).repartition(parts)
    big = {r["k"]: r["s"] for r in common.prefix_sums(df, ["k"], {"s": "v"}, small=10).collect()}
    small = {r["k"]: r["s"] for r in common.prefix_sums(df, ["k"], {"s": "v"}).collect()}
    assert big == small and len(big) == 200
    idx = [r["i"] for r in common.row_index(df, ["k"], "i", small=10).orderBy("k").collect()]
    assert idx == list(range(200))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").otherwise("b")).repartition(parts)
    ids = lambda d: sorted(r["id"] for r in d.select("id").collect())
    base = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").otherwise("b")).coalesce(1)
    assert ids(sampling.sample_random(df, 50, "id")) == ids(sampling.sample_random(base, 50, "id"))
    assert len(ids(sampling.sample_random(df, 50, "id"))) == 50
    assert ids(sampling.sample_systematic(df, 40, "id", small=10)) == list(range(0, 1000, 25))
    st = sampling.sample_stratified(df, 20, "g", "id")
    assert {r["g"]: r["n"] for r in st.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 10, "b": 10}
    assert ids(st) == ids(sampling.sample_stratified(base, 20, "g", "id"))
    assert ids(st) == ids(sampling.sample_stratified(df, 20, "g", "id", small=10))
    assert len(ids(sampling.sample_random(df, 5000, "id"))) == 1000


# ---- neighbours and density clustering -------------------------------------------


def brute_counts(xy, r, inclusive=False):
    d = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2))
    return ((d <= r) if inclusive else (d < r)).sum(axis=1)


@pytest.mark.parametrize("limit", [1, 30, 20_000])
def test_radius_counts_equal_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    # a third of the points crowd one cell, some are equal, some sit on a lattice
    xy = np.concatenate([rng.uniform(0, 0.1, (150, 2)), 0.05 + rng.normal(0, 0.0005, (150, 2)),
                         np.repeat(rng.uniform(0, 0.1, (10, 2)), 8, axis=0),
                         np.array([[i * 0.01, j * 0.01] for i in range(10) for j in range(10)])])
    pts = materialize(neighbours.distinct_points(points(spark, xy)), "t")
    got = {(r["y"], r["x"]): r["hits"] for r in neighbours.radius_counts(pts, pts, 0.01, pair_limit=limit).collect()}
    want = {tuple(p): c for p, c in zip(xy.tolist(), brute_counts(xy, 0.01))}
    assert got == want


def test_density_features_keep_rows(spark):
    xy = np.array([[0.0, 0.0], [0.0, 0.005], [0.0, 0.005], [1.0, 1.0]])
    df = points(spark, xy).unionByName(spark.createDataFrame([(9, None, 1.0)], "event_id long, latitude double, longitude double"))
    got = {r["event_id"]: r["d"] for r in neighbours.density_features(df, {"d": 0.01}).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 0, 9: None}


def brute_dbscan(xy, eps, k):
    near = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= k
    label = np.full(len(xy), -1)
    n = 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = n
                    if core[j]:
                        stack += [m for m in np.flatnonzero(near[j]) if core[m] and label[m] < 0]
            n += 1
    return core, label, near


@pytest.mark.parametrize("limit", [1, 20_000])
def test_dbscan_equals_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 2 * math.pi, 90)
    xy = np.concatenate([np.column_stack([np.cos(t), np.sin(t)]) * 0.05 + rng.normal(0, 0.001, (90, 2)),
                         rng.normal(0, 0.004, (80, 2)), rng.uniform(-0.3, 0.3, (80, 2)), np.array([[0.2, 0.2]] * 6)])
    eps, k = 0.012, 5
    core, want, near = brute_dbscan(xy, eps, k)
    rows = dbscan.dbscan(points(spark, xy), eps, k, pair_limit=limit).orderBy("event_id").collect()
    got = np.array([r["cluster"] for r in rows])
    # same partition of the core points, whatever the numbers
    pairs = {(a, b) for a, b in zip(got[core], want[core])}
    assert len(pairs) == len(set(got[core])) == len(set(want[core]))
    number = {b: a for a, b in pairs}
    for i in np.flatnonzero(~core):
        reach = {number[want[j]] for j in np.flatnonzero(near[i]) if core[j]}
        assert got[i] == (min(reach) if reach else -1)


def test_border_of_a_crowded_cell(spark):
    """Core places crowd in one cell, and the rim around it is decided by splits; equal to the plain search."""
    rng = np.random.default_rng(11)
    t = rng.uniform(0, 2 * math.pi, 60)
    ring = np.column_stack([np.sin(t), np.cos(t)]) * rng.uniform(0.0088, 0.0112, 60)[:, None]
    xy = np.concatenate([rng.uniform(0, 0.0005, (300, 2)), ring, ring[:5] * 3])
    core, want, near = brute_dbscan(xy, 0.01, 320)
    want = np.where(core, want, np.where(near[:, core].any(axis=1), 0, -1))
    assert 300 <= core.sum() < (want == 0).sum() < len(xy)
    rows = dbscan.dbscan(points(spark, xy), 0.01, 320, pair_limit=200).orderBy("event_id").collect()
    assert [r["cluster"] for r in rows] == want.tolist()


def test_scaled_dbscan_uses_standardised_distances(spark):
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.normal(0, 0.02, (60, 2)), rng.normal(1, 0.02, (60, 2)), [[5.0, 5.0]]]) * [1.0, 40.0]
    df = points(spark, xy).unionByName(spark.createDataFrame([(999, None, 1.0)], "event_id long, latitude double, longitude double"))
    got = {r["event_id"]: r["cluster"] for r in dbscan.dbscan_scaled(df).collect()}
    known = np.concatenate([xy[:, 1], [1.0]])  # the row without a latitude still counts for its longitude
    z = np.column_stack([(xy[:, 0] - xy[:, 0].mean()) / xy[:, 0].std(), (xy[:, 1] - known.mean()) / known.std()])
    want = brute_dbscan(z, 0.1, 5)[1]
    assert got.pop(999) is None and [got[i] for i in range(len(xy))] == want.tolist() and set(want) == {-1, 0, 1}
    rep = {r["cluster"]: r for r in dbscan.dbscan_report(dbscan.dbscan_scaled(df), ["latitude"]).collect()}
    assert rep[0]["n"] == 60 and rep[-1]["latitude_mean"] == 5.0 and sum(r["share_pct"] for r in rep.values()) == pytest.approx(100)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.concat_ws("_", F.col("id"), F.lit(0)).alias("u"), F.concat_ws("_", F.col("id") + 1, F.lit(0)).alias("v"))
    nodes = spark.range(301).select(F.concat_ws("_", F.col("id"), F.lit(0)).alias("node"))
    lone = nodes.unionByName(spark.createDataFrame([("-5_7",)], "node string"))
    roots = dbscan.cell_components(lone, edges).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in roots) == [1, 301]


# ---- cleaning and quality ------------------------------------------------------------


def test_box_edges_and_missing(spark):
    rows = [(1, 40.5, -74.3), (2, 41.0, -73.7), (3, 41.0000001, -74.0), (4, 0.0, 0.0), (5, None, -74.0), (6, float("nan"), -74.0)]
    df = clean.canonicalize(spark.createDataFrame(rows, "event_id long, Lat double, Lon double"))
    assert [r["event_id"] for r in df.where(in_city(F.col("latitude"), F.col("longitude"))).orderBy("event_id").collect()] == [1, 2]
    assert df.where("event_id = 6").first()["latitude"] is None


def test_times_that_cannot_be_read(spark):
    df = spark.createDataFrame([("4/1/2014 0:11:00",), ("nonsense",), (None,), ("2014-04-01 05:00:00",)], "datetime string")
    got = [r["hour"] for r in clean.process_datetime(df).collect()]
    assert got == [0, None, None, 5]


def test_fill_by_mode_and_median(spark):
    rows = [("2024-01-01 00:00:00", 40.7, -74.0, b, v) for b, v in (("b", 1.0), ("a", 3.0), (None, None), ("b", 8.0), ("a", 10.0))]
    df = spark.createDataFrame(rows, "datetime string, latitude double, longitude double, base_station string, value double")
    got = clean.handle_missing(clean.parse_datetime(df)).collect()
    assert [r["base_station"] for r in got].count("a") == 3  # tie goes to the least name
    assert sorted(r["value"] for r in got) == [1.0, 3.0, 5.5, 8.0, 10.0]


def test_first_rows_are_found_on_narrow_columns(spark):
    rows = [(1.0, None, "b", 5, "x"), (1.0, None, "a", 9, "y"), (1.0, None, "a", 9, "y"), (1.0, 2.0, "c", 1, "z"), (None, None, None, 3, "p"),
            (None, None, "q", 1, "p"), (-0.0, 1.0, "m", 2, "r"), (0.0, 1.0, "m", 1, "r"), (float("nan"), 1.0, "n", 7, None), (float("nan"), 1.0, "n", 8, "v")]
    df = spark.createDataFrame(rows, "`k.1` double, k2 double, base string, id int, _w string")
    got = common.keep_first(df, ["k.1", "k2"], ["base", "id"])
    assert sorted((r["id"], r["_w"]) for r in got.collect()) == [(1, "r"), (1, "z"), (3, "p"), (7, None), (9, "y")]
    assert got.columns == df.columns and common.keep_first(df.limit(0), ["k2"], ["id"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan and "SortMergeJoin" not in plan


def test_modes_keep_their_types(spark):
    df = spark.createDataFrame([(10, "b", 1.5), (9, "b", None), (10, "a", None), (9, "a", None), (None, None, None)], "i long, s string, d double")
    assert clean._typed_modes(df, ["i", "s", "d"]) == {"i": 9, "s": "a", "d": 1.5}
    assert clean._typed_modes(df.where("s IS NULL"), ["i", "s"]) == {"i": None, "s": None}


def test_dedupe_is_idempotent(spark):
    rows = [("x", 1.0, 2.0, "b", 2), ("x", 1.0, 2.0, "a", 3), ("x", 1.0, 2.0, "a", 3), ("y", 1.0, 2.0, "c", 1)]
    df = spark.createDataFrame(rows, "datetime string, latitude double, longitude double, base_station string, event_id int")
    once = clean.remove_duplicates(df)
    assert sorted(tuple(r) for r in once.collect()) == [("x", 1.0, 2.0, "a", 3), ("y", 1.0, 2.0, "c", 1)]
    assert sorted(map(tuple, clean.remove_duplicates(once).collect())) == sorted(map(tuple, once.collect()))


def test_quality_report_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, s string")
    got = {r["item"]: r["value"] for r in explore.distinct_counts(df).collect()}
    assert got == {"rows": 3, "duplicate_rows": 1, "columns": 2, "unique:k": 2, "unique:s": 1}
    v = {r["column_name"]: (r["status"], r["bad_values"]) for r in quality.validate_types(
        spark.createDataFrame([("1",), ("x",)], "a string"), {"a": "INT", "b": "INT"}).collect()}
    assert v == {"a": ("invalid", 1), "b": ("missing", 0)}


# ---- calendar and numbers ---------------------------------------------------------------


def test_holidays(spark):
    yes = ["2024-01-01", "2021-12-31", "2024-01-15", "2024-05-27", "2024-06-19", "2020-07-03", "2023-11-10", "2024-11-28", "2022-12-26", "2023-01-02"]
    no = ["2024-01-02", "2024-01-08", "2019-06-19", "2024-05-20", "2024-11-21", "2024-07-05"]
    df = spark.createDataFrame([(d,) for d in yes + no], "d string").withColumn("h", cal.is_us_holiday(F.to_date("d")))
    got = {r["d"]: r["h"] for r in df.collect()}
    assert [d for d in yes if not got[d]] == [] and [d for d in no if got[d]] == []


def test_numbers(spark):
    df = spark.createDataFrame([(1234567.0,), (-1234.0,), (12.345,), (0.0,)], "x double")
    assert [r[0] for r in df.select(human_number(F.col("x"))).collect()] == ["1.23M", "-1.23K", "12.35", "0.00"]
    p = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(normal_quantile(F.col("p"))).collect()
    assert np.allclose([r[0] for r in p], [0.0, 1.959963985, -3.090232306], atol=1e-7)


def test_bins_on_edges(spark):
    df = spark.createDataFrame([(float(i) / 10,) for i in range(11)], "x double")
    got = [r[0] for r in df.select(equal_width_bin(F.col("x"), 0.0, 1.0, 10)).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    h = chartdata.histogram(df, "x", 5)
    assert h.agg(F.sum("n")).first()[0] == 11
    one = chartdata.histogram(df.limit(1), "x", 5).collect()
    assert len(one) == 1 and one[0]["bin"] == 0
    gap = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 0.0), (None, 1.0)], "g string, x double")
    assert [r["n"] for r in chartdata.histogram(gap.drop("g"), "x", 5).orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    assert chartdata.histogram(gap, "x", 5, "g").count() == 15 and chartdata.histogram(gap.where("x > 99"), "x", 5).count() == 0


def test_far_groups_give_all_nodes_and_cells(spark):
    xy = spark.createDataFrame([(40.0 + k % 2 + k * 1e-6, -74.0 + k % 2 + (k % 7) * 1e-6) for k in range(2000)], "latitude double, longitude double")
    assert chartdata.kde_grid(xy).count() == 10_000
    cells = chartdata.hist2d(xy, bins=10)
    assert cells.count() == 100 and cells.agg(F.sum("n")).first()[0] == 2000


def test_many_clusters_have_indices(spark):
    df = spark.range(2400).select((F.col("id") % 600).cast("int").alias("cluster"), (F.col("id") % 600 + F.col("id") / 1e5).alias("a"), F.lit(1.0).alias("b"))
    got = cluster.quality_indices(df, ["a", "b"]).first()
    assert got["clusters"] == 600 and got["silhouette"] > 0.9


def test_quality_indices_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    lab = rng.integers(0, 23, 400)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(lab, 0.4), "b": rng.normal(lab % 5, 0.4), "cluster": lab}))
    whole = cluster.quality_indices(df, ["a", "b"]).first()
    monkeypatch.setattr(cluster, "PER_BLOCK", 4)
    assert cluster.quality_indices(df, ["a", "b"]).first() == pytest.approx(whole, rel=1e-9)
    dist = {k: np.sqrt(((g[["a", "b"]] - g[["a", "b"]].mean()) ** 2).sum(axis=1)).mean() for k, g in df.toPandas().groupby("cluster")}
    mid = {k: g[["a", "b"]].mean().to_numpy() for k, g in df.toPandas().groupby("cluster")}
    worst = [max((dist[i] + dist[j]) / np.linalg.norm(mid[i] - mid[j]) for j in mid if j != i) for i in mid]
    assert whole["davies_bouldin"] == pytest.approx(np.mean(worst))


# ---- series --------------------------------------------------------------------------------


def test_gaps_are_filled(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 01:10:00", 2.0), ("a", "2024-01-01 04:10:00", 5.0), ("b", "2024-01-01 09:00:00", 3.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("datetime", F.expr("cast(t as timestamp_ntz)"))
    n = [r["demand"] for r in series.hourly_counts(df, ["k"]).orderBy("k", "hour").collect()]
    assert n == [1, 1, 0, 0, 1, 1]
    y = [r["y"] for r in series.hourly_mean_ffill(df, "v", ["k"]).orderBy("k", "hour").collect()]
    assert y == [1.0, 2.0, 2.0, 2.0, 5.0, 3.0]


def test_single_row_has_no_spread_or_lag(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00",)], "t string").withColumn("datetime", F.expr("cast(t as timestamp_ntz)"))
    h = series.add_rolling(series.add_lags(series.hourly_counts(df), "demand", [1]), "demand", [3]).first()
    assert h["order_count_lag_1"] is None and h["order_count_rolling_std_3"] is None and h["order_count_rolling_mean_3"] == 1.0


def test_ewma_equals_the_recursion(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 20, 400)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3600, 400)), unit="s")
    e = None
    for v in x:
        if v > 0:
            e = v if e is None else 0.1 * v + 0.9 * e
    df = spark.createDataFrame(pd.DataFrame({"event_id": range(400), "ts": t, "w": x})).withColumn("datetime", F.col("ts").cast("timestamp_ntz"))
    got = series.ewma_final(df.repartition(5), "w", [], ["datetime", "event_id"]).first()
    assert got["ewma"] == pytest.approx(e, abs=1e-12) and got["n"] == int((x > 0).sum())


def test_ewma_of_one_hot_minute(spark):
    """A third of a million rows of one key in one minute, dealt over several partitions."""
    n = 300_000
    df = spark.range(n).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + (id * 7919) % 59000000) AS datetime",
                                   "CAST((id * 31) % 97 AS DOUBLE) AS w", "IF(id % 3 = 0, 'rare', 'hot') AS k")
    got = {r.k: r for r in series.ewma_final(df.repartition(6), "w", ["k"], ["datetime", "event_id"]).collect()}
    want, size = {}, {}
    for i in sorted(range(n), key=lambda i: ((i * 7919) % 59000000, i)):
        k, x = ("rare" if i % 3 == 0 else "hot"), float((i * 31) % 97)
        if x > 0:
            want[k] = x if k not in want else 0.1 * x + 0.9 * want[k]
            size[k] = size.get(k, 0) + 1
    assert {k: r.n for k, r in got.items()} == size
    assert all(got[k].ewma == pytest.approx(want[k], rel=1e-12) for k in want)


# ---- metrics -----------------------------------------------------------------------------------


def test_regression_metrics_by_hand(spark):
    y, p = np.array([0.0, 2.0, 4.0, 5.0]), np.array([1.0, 2.0, 3.0, 7.0])
    row = metrics.regression_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "yhat": p}))).first()
    assert row["mse"] == pytest.approx(1.5) and row["mae"] == pytest.approx(1.0)
    assert row["r2"] == pytest.approx(1 - 6 / ((y - y.mean()) ** 2).sum(), abs=1e-6)
    assert row["mape"] == pytest.approx(np.mean([0, 0.25, 0.4]) * 100, abs=1e-6)  # y = 0 has no relative error
    assert row["mape_robust"] == pytest.approx(25.0)
    assert row["smape"] == pytest.approx(100 * np.mean([2, 0, 2 / 7, 4 / 12]), abs=1e-5)


@pytest.mark.parametrize("small", [1, 1_000_000])
def test_auc_with_ties(spark, small):
    y, s = [0, 0, 1, 1, 0, 1], [1, 2, 2, 3, 3, 4]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s int")
    pairs = [(a, b) for ya, a in zip(y, s) if ya for yb, b in zip(y, s) if not yb]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    assert metrics.roc_auc(df, "y", "s", small=small).first()["auc"] == pytest.approx(want, abs=1e-6)
    curve = metrics.roc_curve(df, "y", "s", small=small).orderBy("fpr", "tpr").collect()
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip([{"fpr": 0, "tpr": 0}, *curve], curve))
    assert area == pytest.approx(want, abs=1e-5)


def test_three_class_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "y int, yhat int")
    got = {r["label"]: (round(r["precision"], 4), round(r["recall"], 4), r["support"]) for r in metrics.class_report(df).collect()}
    assert got == {0: (1.0, 0.5, 2), 1: (0.3333, 1.0, 1), 2: (1.0, 0.6667, 3)}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.9), ("c", 3.0, 0.1)], "model string, mae double, r2 double")
    got = {(r["model"], r["metric"]): r["rank"] for r in metrics.rank_models(df, ["mae", "r2"]).collect()}
    assert got == {("a", "mae"): 1.5, ("b", "mae"): 1.5, ("c", "mae"): 3.0, ("a", "r2"): 2.0, ("b", "r2"): 1.0, ("c", "r2"): 3.0}


# ---- clusters, encoding, charts -----------------------------------------------------------------


def test_quality_indices_match_definitions(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(5, 1, (30, 2)), rng.normal([0, 6], 0.5, (20, 2))])
    lab = np.repeat([0, 1, 2], [40, 30, 20])
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "cluster": lab}))
    got = cluster.quality_indices(df, ["a", "b"]).first()
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    sil = []
    for i in range(len(x)):
        own = d2[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        oth = min(d2[i][lab == c].mean() for c in {0, 1, 2} - {lab[i]})
        sil.append((oth - own) / max(oth, own))
    assert got["silhouette"] == pytest.approx(np.mean(sil), abs=1e-9)
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    assert got["silhouette"] == pytest.approx(ClusteringEvaluator(predictionCol="cluster").evaluate(v), abs=1e-9)
    zero = cluster.quality_indices(df.withColumn("cluster", F.lit(0)), ["a", "b"]).first()
    assert zero["silhouette"] == 0.0


def test_planted_clusters_are_found(spark):
    rng = np.random.default_rng(6)
    centers = np.array([[40.6, -74.2], [40.7, -74.0], [40.9, -73.8]])
    xy = np.concatenate([c + rng.normal(0, 0.003, (60, 2)) for c in centers])
    got = cluster.kmeans(points(spark, xy), ["latitude", "longitude"], 3).orderBy("event_id").collect()
    assert [r["cluster"] for r in got] == [0] * 60 + [1] * 60 + [2] * 60
    scan = cluster.k_scan(points(spark, xy), ["latitude", "longitude"], [2, 3, 4])
    assert cluster.pick_k(scan, "silhouette") == cluster.pick_k(scan, "davies") == 3


def test_kde_matches_the_sum_over_points(spark):
    rng = np.random.default_rng(7)
    xy = rng.normal(0, 1, (60, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    got = {(r["iy"], r["ix"]): r["density"] for r in chartdata.kde_grid(points(spark, xy), nodes=12).collect()}
    cov = np.cov(xy.T) * 60 ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)) * 60)
    gy, gx = (np.linspace(xy[:, k].min(), xy[:, k].max(), 12) for k in (0, 1))
    for (i, j), v in got.items():
        d = xy - np.array([gy[i], gx[j]])
        assert v == pytest.approx(norm * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, inv, d)).sum(), abs=2e-6)


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    for m in ("standard", "minmax", "robust"):
        assert [r["b_scaled"] for r in encode.scale(df, ["a", "b"], m).collect()] == [0.0, 0.0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "event_id long, datetime timestamp_ntz, latitude double, longitude double, base_station string, value double")
    assert clean.clean_coordinates(df).count() == 0
    assert clean.handle_missing(df).count() == 0
    assert clean.remove_outliers_iqr(df).count() == 0
    assert series.hourly_counts(df).count() == 0
    assert neighbours.density_features(df, {"d": 0.01}).count() == 0
    assert dbscan.dbscan(df.select("latitude", "longitude"), 0.01, 5).count() == 0
    assert quality.summary_statistics(df).where("n = 0").count() == 6
    assert chartdata.hexbin(df).count() == 0
    assert chartdata.kde_grid(df).count() == 0


def test_zscore_passes_over_a_constant_column(spark):
    from tripweave.operators.clean import remove_outliers_zscore

    df = spark.createDataFrame([(5.0, float(k % 3)) for k in range(50)] + [(5.0, 1000.0)], "a double, b double")
    assert remove_outliers_zscore(df, ["a", "b"]).count() == 50


def test_kmeans_starts_beat_a_single_one(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in [(0, 0), (0, 4), (5, 0), (5, 5), (9, 1)]])
    df = spark.createDataFrame(pd.DataFrame(xy, columns=["a", "b"]))
    found = cluster.fit_centers(df, [3, 5], passes=30)
    for k, (centers, cost) in found.items():
        gaps = ((xy[:, None] - centers) ** 2).sum(2)
        assert cost == pytest.approx(gaps.min(1).sum(), rel=1e-3)
        single = KMeans(k=k, seed=1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)).summary.trainingCost
        assert cost <= single * (1 + 1e-6)
    lonely = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    assert [r.cluster for r in cluster.kmeans(lonely, ["a", "b"], 4).orderBy("b").collect()] == [0, None]
    assert [r.cluster for r in cluster.kmeans(lonely.where("a IS NULL"), ["a", "b"], 4).collect()] == [None]


def test_k_scan_equals_the_indices_of_its_labels(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(c, s, (200, 2)) for c, s in [((40, -74), 0.3), ((43, -74), 1), ((45, -70), 0.1)]])
    df = spark.createDataFrame(pd.DataFrame(xy, columns=["a", "b"])).unionByName(spark.createDataFrame([(None, 1.0), (60.0, 60.0)], "a double, b double"))
    got = {r.k: r for r in cluster.k_scan(df, ["a", "b"], [2, 4, 7], scaled=False).collect()}
    found = cluster.fit_centers(df, [2, 4, 7])
    for k, (centers, cost) in found.items():
        want = cluster.quality_indices(df.withColumn("cluster", cluster.nearest([F.col("a"), F.col("b")], centers)), ["a", "b"]).first()
        assert got[k].inertia == pytest.approx(cost) and tuple(got[k])[2:] == pytest.approx(tuple(want))
    one = cluster.k_scan(df.where("a IS NULL"), ["a", "b"], [2], scaled=False).first()
    assert tuple(one) == (2, 0.0, 0, 0.0, 0.0, 0.0)


def test_k_means_moves_over_all_rows_in_few_scans(spark, monkeypatch):
    df = spark.range(60_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    calls, plain = [], cluster._pass
    monkeypatch.setattr(cluster, "_pass", lambda base, jobs: calls.append(len(jobs)) or plain(base, jobs))
    cluster.fit_centers(df, [12])
    assert len(calls) <= 4 and cluster.kmeans(df, ["a", "b"], 3).select("cluster").distinct().count() == 3


def test_tasks_hold_few_rows_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    sizes = [r.n for r in session.spread_rows(spark.range(0, 5_000, 1, 1)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= 110


def test_bisecting_keeps_few_rows_a_task(spark, monkeypatch):
    seen, plain = [], cluster.BisectingKMeans

    class Watched:
        def __init__(self, **kw):
            self.inner = plain(**kw)

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return self.inner.fit(df)

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    monkeypatch.setattr(cluster, "BisectingKMeans", Watched)
    df = materialize(spark.range(4_000).select(F.rand(1).alias("a"), F.rand(2).alias("b")), "bisecting")
    found = cluster._bisecting(df, ["a", "b"], 3, 42)
    assert seen == [40] and len(found) == 3 and len({tuple(c) for c in found}) == 3


def test_distinct_values_of_every_type(spark):
    from tripweave.operators import explore

    df = spark.createDataFrame([(1, 10**15, 0.0, "0", True, None), (2, -5, -0.0, "0.0", None, None), (1, 7, float("nan"), None, True, None),
                                (None, 7, float("nan"), "x", False, None)], "a int, `b.c` bigint, d double, s string, f boolean, z double")
    got = {r.column_name: r.value for r in explore.distinct_values(df).collect()}
    assert got == {"a": 2, "b.c": 3, "d": 2, "s": 3, "f": 2, "z": 0}
    assert {r.value for r in explore.distinct_values(df.limit(0)).collect()} == {0}
    many = spark.range(-40_000, 60_000).selectExpr("id AS dense", "id * 1000003 AS sparse", "id % 7 AS few")
    assert {r.column_name: r.value for r in explore.distinct_values(many).collect()} == {"dense": 100_000, "sparse": 100_000, "few": 13}


def test_backtest_of_each_key(spark):
    from tripweave.operators import forecast

    hours = pd.date_range("2024-01-01", periods=24 * 14, freq="h")
    y = 20 + 10 * np.sin(np.arange(len(hours)) * 2 * np.pi / 24)
    rows = pd.concat([pd.DataFrame({"k": "wave", "hour": hours, "y": y}), pd.DataFrame({"k": "flat", "hour": hours, "y": 5.0 + np.arange(len(hours)) % 2}),
                      pd.DataFrame({"k": "short", "hour": hours[:20], "y": 1.0})])
    s = spark.createDataFrame(rows).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    f = forecast.backtest(s, ["k"])
    assert {(r.k, r.model): r.n for r in f.groupBy("k", "model").agg(F.count("*").alias("n")).collect()} == {
        (k, m): 68 for k in ("wave", "flat") for m in ("arima", "additive")}
    err = {(r.k, r.model): r.rmse for r in forecast.forecast_errors(f, ["k"]).collect()}
    assert err["wave", "additive"] < 3 < err["wave", "arima"]
    own = f.toPandas().groupby(["k", "model"])[["y", "yhat"]].apply(lambda g: float(np.sqrt(((g.y - g.yhat) ** 2).mean())))
    assert all(err[k] == pytest.approx(v, abs=1e-6) for k, v in own.items())


def test_quantiles_of_one_column_share_a_sketch(spark, monkeypatch):
    from tripweave.operators import quantile

    df = spark.range(4000).selectExpr("(id * 7919 % 4000) / 8.0D AS x", "CASE WHEN id % 3 > 0 THEN CAST(id % 5 AS DOUBLE) END AS y")
    made, real = [], F.percentile_approx
    monkeypatch.setattr(quantile.F, "percentile_approx", lambda *a: made.append(a) or real(*a))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = exact_quantiles(df, {"x": probs, "y": probs}, direct_limit=100)
    assert len(made) == 2  # one round settles both columns; a sketch a column, not one a figure
    assert got == {c: pytest.approx(v) for c, v in exact_quantiles(df, {"x": probs, "y": probs}).items()}
