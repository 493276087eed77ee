"""Models recover known generators; solvers agree with their definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripweave.operators import anomaly, encode, forecast, models
from tripweave.session import scratch_path


def hourly(spark, y, key="a"):
    t = pd.date_range("2024-01-01", periods=len(y), freq="h")
    df = spark.createDataFrame(pd.DataFrame({"k": key, "ts": t, "y": y}))
    return df.select("k", F.col("ts").cast("timestamp_ntz").alias("hour"), "y")


def test_decomposition_adds_up_and_finds_the_season(spark):
    i = np.arange(24 * 8)
    y = 0.05 * i + 3 * np.sin(2 * np.pi * i / 24)
    rows = forecast.decompose(hourly(spark, y), ["k"]).orderBy("hour").toPandas()
    assert np.allclose(rows.trend + rows.seasonal + rows.resid, y)
    assert np.allclose(rows.trend, 0.05 * i, atol=1e-9)
    assert np.allclose(rows.seasonal, 3 * np.sin(2 * np.pi * i / 24), atol=0.6)
    assert abs(rows.seasonal[:24].sum()) < 1e-9


def test_autocorrelation(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=600)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.7 * y[t - 1] + e[t]
    acf = forecast.autocorrelation(hourly(spark, y), ["k"], lags=10)
    got = {r["lag"]: r["acf"] for r in acf.collect()}
    x = y - y.mean()
    assert got[0] == pytest.approx(1.0) and got[3] == pytest.approx((x[3:] * x[:-3]).sum() / (x * x).sum())
    pacf = {r["lag"]: r["pacf"] for r in forecast.partial_autocorrelation(acf, ["k"]).collect()}
    assert pacf[1] == pytest.approx(got[1]) and abs(pacf[2]) < 0.15


def test_unit_root_and_level_tests(spark):
    rng = np.random.default_rng(2)
    white, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    both = hourly(spark, white, "white").unionByName(hourly(spark, walk, "walk"))
    got = {r["k"]: r for r in forecast.stationarity(both, ["k"]).collect()}
    assert got["white"]["adf_stationary"] and got["white"]["kpss_stationary"] and got["white"]["adf_p"] < 0.01
    assert not got["walk"]["adf_stationary"] and not got["walk"]["kpss_stationary"]


def test_arima_recovers_coefficients():
    rng = np.random.default_rng(3)
    e = rng.normal(size=1500)
    z = np.zeros(1500)
    for t in range(1, 1500):
        z[t] = 0.6 * z[t - 1] + e[t] + 0.3 * e[t - 1]
    phi, theta, s2, aic, bic = forecast.fit_arima(np.cumsum(z), (1, 1, 1))
    assert phi[0] == pytest.approx(0.6, abs=0.08) and theta[0] == pytest.approx(0.3, abs=0.1)
    assert s2 == pytest.approx(1.0, abs=0.1) and bic > aic
    mean, se, _, _ = forecast.forecast_arima(np.arange(60.0), (1, 1, 1), 5)
    assert np.allclose(mean, [60, 61, 62, 63, 64], atol=0.2) and (np.diff(se) >= 0).all()


def test_additive_forecast_continues_a_daily_cycle(spark):
    i = np.arange(24 * 14)
    y = 10 + 0.01 * i + 4 * np.sin(2 * np.pi * i / 24)
    f = forecast.additive_forecast(hourly(spark, y), periods=24, reg=1e-4, yearly=0).where("is_future").orderBy("hour").toPandas()
    j = np.arange(24 * 14, 24 * 15)
    assert len(f) == 24 and np.abs(f.yhat - (10 + 0.01 * j + 4 * np.sin(2 * np.pi * j / 24))).max() < 0.5


def model_table(spark, n=600):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(n), "hour": rng.integers(0, 24, n), "day_of_week": rng.integers(0, 7, n), "month": rng.integers(1, 13, n),
                        "lat_mean": rng.normal(40.7, 0.05, n), "lon_mean": rng.normal(-74, 0.05, n), "base_station": rng.choice(["a", "b"], n)})
    pdf["demand"] = 5 + 2.0 * pdf.hour - 1.0 * pdf.day_of_week + 7.0 * (pdf.base_station == "b") + rng.normal(0, 0.1, n)
    return models.prepare(spark.createDataFrame(pdf), ["id"])


def test_linear_model_and_storage(spark):
    t = model_table(spark)
    m = models.fit(t, "linear", ["base_station"])
    got = {(r["model"], r["split"]): r for r in models.split_metrics(models.score(m, t, ["row_key", "is_test", "demand"]), "linear").collect()}
    assert got["linear", "test"]["r2"] > 0.99 and got["linear", "test"]["rmse"] < 0.2
    assert 60 < got["linear", "test"]["n"] < 180
    path = scratch_path(spark, "m")
    models.save_models({"linear": m}, path)
    again = models.load_models(path, ["linear"])["linear"]
    a = models.score(m, t, ["row_key"]).orderBy("row_key").toPandas()
    b = models.score(again, t, ["row_key"]).orderBy("row_key").toPandas()
    assert np.allclose(a.prediction, b.prediction)
    imp = {r["feature"]: r["importance"] for r in models.importances(m, models.NUMERIC, ["base_station"], spark).collect()}
    assert max(imp, key=imp.get) == "hour"


def test_trees_beat_the_mean_and_vote(spark):
    t = model_table(spark)
    cmp = models.compare(t, {"linear": {}, "random_forest": {"numTrees": 10, "maxDepth": 6}}, ["base_station"]).collect()
    assert all(r["test_r2"] > 0.5 for r in cmp) and min(cmp, key=lambda r: r["rank"])["model"] == "linear"
    v = models.weighted_vote(spark.createDataFrame([(1.0, 4.0)], "a double, b double"), ["a", "b"], [2.0, 1.0]).first()
    assert v["prediction"] == pytest.approx(2.0)


def test_split_is_stable(spark):
    d = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    a = {r["k"] for r in encode.mark_test(d.repartition(7), F.col("k")).where("is_test").collect()}
    b = {r["k"] for r in encode.mark_test(d.coalesce(1), F.col("k")).where("is_test").collect()}
    assert a == b and 300 < len(a) < 500


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (600, 2)), np.array([[12.0, 12.0], [-15.0, 9.0], [0.0, 20.0]])])
    df = spark.createDataFrame(pd.DataFrame({"id": range(603), "a": x[:, 0], "b": x[:, 1]}))
    s = anomaly.isolation_scores(df, ["a", "b"], "id", trees=40)
    top = {r["id"] for r in s.orderBy(F.desc("score")).limit(3).collect()}
    assert top == {600, 601, 602}
    flags = anomaly.isolation_flags(df, ["a", "b"], "id", 0.05, trees=20)
    assert 20 <= flags.where("is_anomaly = 1").count() <= 31


def test_reconstruction_finds_rows_off_the_plane(spark):
    rng = np.random.default_rng(6)
    basis = rng.normal(size=(2, 8))
    x = rng.normal(size=(300, 2)) @ basis
    x[7] += rng.normal(size=8) * 5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, e array<double>")
    got = anomaly.reconstruction_errors(df, "e", 2).orderBy(F.desc("error")).first()
    assert got["id"] == 7 and got["is_anomaly"] == 1


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    got = encode.encode_categorical(df).orderBy(F.col("c").asc_nulls_last()).collect()
    assert [(r["c_encoded"], r["c_a"], r["c_b"], r["c_nan"]) for r in got] == [(1, 1, 0, 0), (2, 0, 1, 0), (0, 0, 0, 1)]
    codes = encode.category_codes(df, ["c"]).collect()
    assert sorted(r["c"] for r in codes) == [-1, 0, 1]


def test_grid_search_goes_on_where_it_stopped(spark, monkeypatch):
    from tripweave.session import scratch_path

    rng = np.random.default_rng(3)
    df = pd.DataFrame({"row_key": [str(k) for k in range(200)], "is_test": False, "hour": rng.integers(0, 24, 200), "day_of_week": 1, "month": 2,
                       "lat_mean": rng.normal(size=200), "lon_mean": 0.5})
    df["demand"] = df["hour"] * 2.0 + rng.normal(size=200)
    table, out, fitted = spark.createDataFrame(df), scratch_path(spark, "grid"), []
    real = models.regressor
    monkeypatch.setattr(models, "regressor", lambda name, **kw: fitted.append(kw) or real(name, **kw))
    one = models.grid_search(table, "linear", {"regParam": [0.0, 100.0]}, folds=3, out=out).collect()
    assert len(fitted) == 6 and {r.folds for r in one} == {3}
    two = models.grid_search(table, "linear", {"regParam": [0.0, 100.0, 1000.0]}, folds=3, out=out).collect()
    assert len(fitted) == 9
    again = {r.params: r.mse for r in two}
    assert all(again[r.params] == pytest.approx(r.mse) for r in one)
    best = min(two, key=lambda r: r.mse)
    assert best.params == "{'regParam': 0.0}" and best.mse < 3
    assert len(list(models.FOREST_GRID)) == 4 and all(len(v) == 3 for g in (models.FOREST_GRID, models.BOOST_GRID) for v in g.values())


def test_ensemble_fits_at_a_time_on_a_table_of_many_files(spark, monkeypatch):
    import threading

    trips = spark.range(2000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id % 7919) AS datetime", "id % 7 / 10.0D AS latitude",
                                         "id % 11 / 10.0D AS longitude", "concat('b', id % 3) AS base_station")
    table = models.prepare(models.demand_table(trips, ["base_station"]), ["base_station", "hour_date"])
    assert table.select(F.input_file_name().alias("f")).distinct().count() > 1
    met, real = threading.Barrier(2), models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **kw: (met.wait(60), real(*a, **kw))[1])
    out = models.ensemble(table, {"linear": {}, "random_forest": {"numTrees": 2, "maxDepth": 2}}, ["base_station"]).collect()
    assert len(out) == table.count()
    assert all(r["prediction"] == pytest.approx((r["p_linear"] + r["p_random_forest"]) / 2) for r in out)
