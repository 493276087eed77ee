"""Time-series analysis and forecasts for many hourly series at once.

Everything up to the hourly table is plain Spark.  What has a closed form stays
there: decomposition, autocorrelation, the additive regression.  The iterative
solvers (unit-root tests, ARIMA) run per series in Arrow batches; a series is a
calendar of hours, so its length does not grow with the number of trips.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from ..functions.numbers import r
from .metrics import regression_aggregates
from .series import minute_start


# ---- decomposition and autocorrelation ------------------------------------------


def decompose(series: DataFrame, keys: Sequence[str], value: str = "y", time: str = "hour", period: int = 24) -> DataFrame:
    """Additive trend, seasonal and residual part of dense hourly series.

    The trend is a centred moving average over one period (half weights at both
    ends when the period is even), continued at the ends by straight lines
    through the nearest ``period`` trend points.
    """
    half = period // 2
    w = W.partitionBy(*keys).orderBy(time)
    wide = w.rowsBetween(-half, half)
    ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2.0 if period % 2 == 0 else F.lit(0.0)
    full = F.count(value).over(wide) == 2 * half + 1
    t = series.withColumns({
        "idx": (F.row_number().over(w) - 1).cast("double"),
        "len": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        "ma": F.when(full, (F.sum(value).over(wide) - ends) / float(period)),
    })
    valid = F.col("ma").isNotNull()
    head = valid & (F.col("idx") < half + period)
    tail = valid & (F.col("idx") >= F.col("len") - half - period)
    every = W.partitionBy(*keys)

    def line(part: Column) -> Column:
        y, x = F.when(part, F.col("ma")), F.when(part, F.col("idx"))
        return F.regr_slope(y, x).over(every) * F.col("idx") + F.regr_intercept(y, x).over(every)

    t = t.withColumn("trend", F.coalesce("ma", F.when(F.col("idx") < half, line(head)).otherwise(line(tail))))
    t = t.withColumn("phase", (F.col("idx") % period).cast("int")).withColumn("_d", F.col(value) - F.col("trend"))
    per_phase = F.avg("_d").over(W.partitionBy(*keys, "phase"))
    t = t.withColumn("_p", per_phase)
    # the mean over phases counts every phase once
    first = F.col("idx") < period
    t = t.withColumn("seasonal", F.col("_p") - F.avg(F.when(first, F.col("_p"))).over(every))
    return t.select(*keys, time, F.col(value).alias("observed"), "trend", "seasonal",
                    (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def autocorrelation(series: DataFrame, keys: Sequence[str], value: str = "y", time: str = "hour", lags: int = 50) -> DataFrame:
    """(keys, lag, acf) for lags 0..n: all lags from one window pass, no self-join."""
    every = W.partitionBy(*keys)
    w = W.partitionBy(*keys).orderBy(time)
    x = series.withColumn("_x", F.col(value) - F.avg(value).over(every))
    shifted = x.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("c0"),
                                      *[F.sum(F.col("_x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"c{k}"), F.col("c0")).alias("acf")) for k in range(lags + 1)])
    return sums.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial autocorrelations from the autocorrelations by the Durbin-Levinson recursion."""
    schema = ", ".join([f"{k} string" for k in keys] + ["lag int", "pacf double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        rho = pdf["acf"].to_numpy(dtype=float)
        out, phi, v = [1.0], np.zeros(0), 1.0
        for k in range(1, len(rho)):
            a = (rho[k] - (phi * rho[k - 1:0:-1]).sum()) / v if v > 1e-12 else float("nan")
            phi = np.append(phi - a * phi[::-1], a)
            v *= 1 - a * a
            out.append(a)
        res = pd.DataFrame({"lag": pdf["lag"].to_numpy(), "pacf": out})
        for k in keys:
            res.insert(0, k, pdf[k].iloc[0])
        return res[[*keys, "lag", "pacf"]]

    return acf.groupBy(*keys).applyInPandas(solve, schema)


# ---- stationarity -------------------------------------------------------------------

# Finite-sample critical values of the unit-root test with a constant
# (b0 + b1/T + b2/T^2 + b3/T^3), and its p-value polynomials, as published by MacKinnon.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809),
}
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_TAU_STAR, ADF_TAU_MIN, ADF_TAU_MAX = -1.61, -18.83, 2.74
# Published critical values of the level-stationarity test.
KPSS_CRITICAL = {"10%": 0.347, "5%": 0.463, "2.5%": 0.574, "1%": 0.739}


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ beta
    return beta, float(res @ res), x


def adf_statistic(y: np.ndarray) -> tuple[float, int, int]:
    """(t statistic, lags, observations); the lag count minimises AIC."""
    n = len(y)
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    dy = np.diff(y)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(dy))
        cols = [y[rows], np.ones(len(rows))] + [dy[rows - k] for k in range(1, lags + 1)]
        return dy[rows], np.column_stack(cols)

    best, best_aic = 0, math.inf
    for lags in range(top + 1):
        t, x = design(lags, top)
        _, ssr, _ = _ols(t, x)
        aic = len(t) * (math.log(max(ssr, 1e-300) / len(t)) + 1 + math.log(2 * math.pi)) + 2 * x.shape[1]
        if aic < best_aic:
            best, best_aic = lags, aic
    t, x = design(best, best)
    beta, ssr, _ = _ols(t, x)
    s2 = ssr / (len(t) - x.shape[1])
    se = math.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0])
    return float(beta[0] / se), best, len(t)


def adf_p_value(tau: float) -> float:
    if tau >= ADF_TAU_MAX:
        return 1.0
    if tau <= ADF_TAU_MIN:
        return 0.0
    coefs = ADF_P_SMALL if tau <= ADF_TAU_STAR else ADF_P_LARGE
    z = sum(c * tau**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def kpss_statistic(y: np.ndarray) -> tuple[float, int]:
    """(statistic, lags) around a level, with an automatic Newey-West bandwidth."""
    n = len(y)
    e = y - y.mean()
    m = int(n ** (2.0 / 9.0))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, m + 1):
        g = float(e[i:] @ e[:-i]) / (n / 2.0)
        s0 += g
        s1 += i * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1) if s0 else 0
    lrv = float(e @ e)
    for i in range(1, lags + 1):
        lrv += 2.0 * float(e[i:] @ e[:-i]) * (1.0 - i / (lags + 1.0))
    return float((np.cumsum(e) ** 2).sum() / n**2 / (lrv / n)), lags


def stationarity(series: DataFrame, keys: Sequence[str], value: str = "y", time: str = "hour") -> DataFrame:
    """Unit-root and level-stationarity test per series, with the verdicts at 5 %."""
    schema = ", ".join([f"{k} string" for k in keys] + [
        "adf double", "adf_lags int", "adf_p double", "adf_critical_5 double", "adf_stationary boolean",
        "kpss double", "kpss_lags int", "kpss_p double", "kpss_critical_5 double", "kpss_stationary boolean"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[value].to_numpy(dtype=float)
        y = y[~np.isnan(y)]
        row: dict = {k: pdf[k].iloc[0] for k in keys}
        if len(y) >= 20 and y.std() > 0:
            tau, lags, n = adf_statistic(y)
            crit = sum(b / n**i for i, b in enumerate(ADF_CRITICAL["5%"]))
            stat, klags = kpss_statistic(y)
            levels, probs = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]
            row |= {"adf": tau, "adf_lags": lags, "adf_p": adf_p_value(tau), "adf_critical_5": crit, "adf_stationary": bool(tau < crit),
                    "kpss": stat, "kpss_lags": klags, "kpss_p": float(np.interp(stat, levels, probs)),
                    "kpss_critical_5": KPSS_CRITICAL["5%"], "kpss_stationary": bool(stat < KPSS_CRITICAL["5%"])}
        cols = [c.strip().split(" ")[0] for c in schema.split(",")]
        return pd.DataFrame([row], columns=cols)

    return series.groupBy(*keys).applyInPandas(solve, schema)


# ---- ARIMA ------------------------------------------------------------------------------


def _arma_residuals(z: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    p, m = len(phi), len(theta)
    e = np.zeros(len(z))
    for t in range(p, len(z)):
        v = z[t]
        for i in range(p):
            v -= phi[i] * z[t - 1 - i]
        for j in range(min(m, t)):
            v -= theta[j] * e[t - 1 - j]
        e[t] = v
    return e


def fit_arima(y: np.ndarray, order: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(phi, theta, sigma2, aic, bic): long autoregression for a start, then
    Gauss-Newton steps on the conditional sum of squares."""
    p, d, m = order
    z = np.diff(y, n=d) if d else np.asarray(y, dtype=float)
    n = len(z)
    long = min(max(p, m) + 5, n // 4)
    lagged = np.column_stack([z[long - k - 1:n - k - 1] for k in range(long)])
    beta, *_ = np.linalg.lstsq(lagged, z[long:], rcond=None)
    e = np.zeros(n)
    e[long:] = z[long:] - lagged @ beta
    first = long + max(p, m)
    cols = [z[first - i - 1:n - i - 1] for i in range(p)] + [e[first - j - 1:n - j - 1] for j in range(m)]
    par = np.linalg.lstsq(np.column_stack(cols), z[first:], rcond=None)[0] if cols else np.zeros(0)
    par = np.clip(par, -0.95, 0.95)

    def res(v: np.ndarray) -> np.ndarray:
        return _arma_residuals(z, v[:p], v[p:])

    e = res(par)
    best = float(e @ e)
    for _ in range(25 if len(par) else 0):
        jac = np.column_stack([(res(par + 1e-5 * np.eye(len(par))[i]) - e) / 1e-5 for i in range(len(par))])
        step = np.linalg.lstsq(jac, -e, rcond=None)[0]
        scale, moved = 1.0, False
        while scale > 1e-4:
            new = np.clip(par + scale * step, -0.999, 0.999)
            e_new = res(new)
            s = float(e_new @ e_new)
            if np.isfinite(s) and s < best * (1 - 1e-10):
                par, e, best, moved = new, e_new, s, True
                break
            scale /= 2
        if not moved:
            break
    used = max(n - p, 1)
    sigma2 = max(best / used, 1e-300)
    loglik = -0.5 * used * (math.log(2 * math.pi * sigma2) + 1)
    k = p + m + 1
    return par[:p], par[p:], sigma2, -2 * loglik + 2 * k, -2 * loglik + k * math.log(used)


def forecast_arima(y: np.ndarray, order: tuple[int, int, int], steps: int):
    """(mean, standard error, aic, bic) of the next steps."""
    p, d, m = order
    phi, theta, s2, aic, bic = fit_arima(y, order)
    z = np.diff(y, n=d) if d else np.asarray(y, dtype=float)
    e = list(_arma_residuals(z, phi, theta))
    zs = list(z)
    for _ in range(steps):
        zs.append(sum(phi[i] * zs[-1 - i] for i in range(p)) + sum(theta[j] * e[-1 - j] for j in range(m)))
        e.append(0.0)
    mean = np.array(zs[len(z):])
    # weights of past shocks, summed up once per differencing
    psi = [1.0]
    for k in range(1, steps):
        psi.append((theta[k - 1] if k <= m else 0.0) + sum(phi[i] * psi[k - 1 - i] for i in range(min(p, k))))
    weights = np.array(psi)
    for lvl in range(d):
        weights = np.cumsum(weights)
        last = np.diff(y, n=d - 1 - lvl)[-1] if d - 1 - lvl else y[-1]
        mean = last + np.cumsum(mean)
    return mean, np.sqrt(s2 * np.cumsum(weights**2)), aic, bic


def arima_forecast(series: DataFrame, keys: Sequence[str], value: str = "y", time: str = "hour",
                   order: tuple[int, int, int] = (1, 1, 1), steps: int = 24) -> DataFrame:
    """(keys, hour, yhat, lo, hi, aic, bic) for the next hours of every series."""
    schema = ", ".join([f"{k} string" for k in keys] + [f"{time} timestamp_ntz", "yhat double", "lo double", "hi double",
                                                        "aic double", "bic double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        y = pdf[value].to_numpy(dtype=float)
        cols = [*keys, time, "yhat", "lo", "hi", "aic", "bic"]
        if len(y) < 30:
            return pd.DataFrame(columns=cols)
        mean, se, aic, bic = forecast_arima(y, order, steps)
        at = pd.to_datetime(pdf[time].iloc[-1]) + pd.to_timedelta(np.arange(1, steps + 1), unit="h")
        out = pd.DataFrame({time: at, "yhat": mean, "lo": mean - 1.959964 * se, "hi": mean + 1.959964 * se, "aic": aic, "bic": bic})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[cols]

    return series.groupBy(*keys).applyInPandas(solve, schema)


# ---- additive regression -----------------------------------------------------------------


def additive_design(df: DataFrame, time: str, start: Column, span: Column, changepoints: int = 25, yearly: int = 10,
                    weekly: int = 3, daily: int = 4) -> tuple[DataFrame, list[str]]:
    """Columns of an additive model: trend, hinges over the first 80 %, Fourier pairs."""
    secs = F.unix_timestamp(F.col(time).cast("timestamp")).cast("double")
    cols: dict[str, Column] = {"x_t": (secs - start) / span}
    for i in range(1, changepoints + 1):
        knot = 0.8 * i / (changepoints + 1)
        cols[f"x_h{i}"] = F.greatest(F.col("x_t") - F.lit(knot), F.lit(0.0))
    for name, days, order in (("y", 365.25, yearly), ("w", 7.0, weekly), ("d", 1.0, daily)):
        for k in range(1, order + 1):
            angle = F.col("x_s") * F.lit(2 * math.pi * k / (days * 86400.0))
            cols[f"x_{name}s{k}"], cols[f"x_{name}c{k}"] = F.sin(angle), F.cos(angle)
    df = df.withColumn("x_s", secs).withColumn("x_t", cols.pop("x_t")).withColumns(cols)
    return df, ["x_t", *cols]


def additive_forecast(series: DataFrame, value: str = "y", time: str = "hour", periods: int = 24, unit: str = "HOUR",
                      changepoints: int = 25, reg: float = 0.05, yearly: int = 10, weekly: int = 3, daily: int = 4) -> DataFrame:
    """(time, y, yhat, is_future): fit of the past and the next ``periods``, from one ridge regression."""
    ends = series.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    e = ends.select(sec("a").alias("a"), sec("b").alias("b")).first()  # one row
    start, span = F.lit(e["a"]), F.lit(max(e["b"] - e["a"], 1.0))
    kw = {"changepoints": changepoints, "yearly": yearly, "weekly": weekly, "daily": daily}
    past, cols = additive_design(series.select(time, F.col(value).cast("double").alias("y")), time, start, span, **kw)
    step = F.expr(f"INTERVAL 1 {unit}")
    future = ends.select(F.explode(F.sequence(F.col("b") + step, F.col("b") + F.expr(f"INTERVAL {periods} {unit}"), step)).alias(time),
                         F.lit(None).cast("double").alias("y"))
    future, _ = additive_design(future, time, start, span, **kw)
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), LinearRegression(
        labelCol="y", regParam=reg, elasticNetParam=0.0, solver="normal")]).fit(past)
    out = model.transform(past.unionByName(future))
    return out.select(time, "y", F.col("prediction").alias("yhat"), F.col("y").isNull().alias("is_future"))


def forecast_trend(forecast: DataFrame, keys: Sequence[str], time: str = "hour") -> DataFrame:
    """Direction (last against first) and range of a forecast."""
    g = forecast.groupBy(*keys) if keys else forecast.groupBy()
    return g.agg(F.when(F.max_by("yhat", time) > F.min_by("yhat", time), "up").otherwise("down").alias("trend"),
                 r(F.min("yhat")).alias("low"), r(F.max("yhat")).alias("high"))


def chronological_split(series: DataFrame, time: str = "hour", share: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """``is_test`` for the last ``share`` of every hourly series."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    rank = F.row_number().over(w.orderBy(time))
    size = F.count(F.lit(1)).over(w)
    return series.withColumn("is_test", rank > F.floor(size * (1 - share)))


def fit_additive(t: np.ndarray, y: np.ndarray, at: np.ndarray, changepoints: int = 25, reg: float = 0.05, yearly: int = 10,
                 weekly: int = 3, daily: int = 4) -> np.ndarray:
    """Values at the seconds ``at`` of the additive model (trend, hinges, Fourier pairs) fitted by ridge regression to (t, y)."""
    start, span = t[0], max(t[-1] - t[0], 1.0)

    def design(s: np.ndarray) -> np.ndarray:
        x = (s - start) / span
        cols = [x, *[np.maximum(x - 0.8 * i / (changepoints + 1), 0) for i in range(1, changepoints + 1)]]
        for days, order in ((365.25, yearly), (7.0, weekly), (1.0, daily)):
            for k in range(1, order + 1):
                angle = s * (2 * math.pi * k / (days * 86400.0))
                cols += [np.sin(angle), np.cos(angle)]
        return np.column_stack(cols)

    past = design(t)
    mean, std = past.mean(0), past.std(0)
    z = (past - mean) / np.where(std > 0, std, 1.0)
    w = np.linalg.solve(z.T @ z / len(y) + reg * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(y))
    return y.mean() + (design(at) - mean) / np.where(std > 0, std, 1.0) @ w


def backtest(series: DataFrame, keys: Sequence[str], value: str = "y", time: str = "hour", share: float = 0.2,
             order: tuple[int, int, int] = (1, 1, 1), need: int = 30) -> DataFrame:
    """(keys, time, model, y, yhat): forecasts of the last part of every series from what comes before it.

    The two parts of a key meet in one cogroup, so series are spread over the tasks; a series has a row per hour.  Series with
    fewer than ``need`` hours to learn from, or without later ones, have no rows.
    """
    d = chronological_split(series.select(*keys, time, F.col(value).cast("double").alias("y")), time, share, keys)
    schema = ", ".join([f"{k} {series.schema[k].dataType.simpleString()}" for k in keys] + [f"{time} timestamp_ntz", "model string", "y double", "yhat double"])
    names = [*keys, time, "model", "y", "yhat"]

    def solve(past: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        if len(past) < need or not len(later):
            return pd.DataFrame(columns=names)
        past, later = past.sort_values(time), later.sort_values(time)
        y = past["y"].to_numpy(dtype=float)
        sec = lambda x: pd.to_datetime(x[time]).to_numpy().astype("datetime64[s]").astype(float)
        found = {"arima": forecast_arima(y, order, len(later))[0], "additive": fit_additive(sec(past), y, sec(later))}
        return pd.concat([later.assign(model=m, yhat=v) for m, v in found.items()])[names]

    both = d.where("not is_test").groupBy(*keys).cogroup(d.where("is_test").groupBy(*keys))
    return materialize(both.applyInPandas(solve, schema), "backtest")  # fitted once, however often the forecasts are read


def forecast_errors(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, n, rmse, mae) of back-tested forecasts."""
    agg = regression_aggregates("y", "yhat")
    return forecasts.groupBy(*keys, "model").agg(agg["n"].alias("n"), r(agg["rmse"]).alias("rmse"), r(agg["mae"]).alias("mae"))


# ---- short-term rules ----------------------------------------------------------------------


def short_term_forecast(df: DataFrame, time: str = "datetime", order: Sequence[str] = ("datetime", "event_id"),
                        last: int | None = None, need: int = 5) -> DataFrame:
    """``minutes_forecast`` of the minutes with events.  ``last`` looks at the last so many events only."""
    recent = df if last is None else df.orderBy(*[F.desc(c) for c in order]).limit(last)
    return minutes_forecast(recent.where(F.col(time).isNotNull()).groupBy(minute_start(time).alias("minute")).agg(F.count("*").alias("n")), need)


def minutes_forecast(minutes: DataFrame, need: int = 5) -> DataFrame:
    """Five one-minute steps from the last five rows of (minute, n): m, then m * (1 + 0.1 i); zeros if there are fewer
    than ``need`` minutes."""
    minutes = minutes.orderBy(F.desc("minute")).limit(max(need, 5))
    ranked = minutes.withColumn("back", F.row_number().over(W.orderBy(F.desc("minute"))))
    s = ranked.agg(F.count("*").alias("minutes"), F.avg(F.when(F.col("back") <= 5, F.col("n"))).alias("m"))
    ok = F.col("minutes") >= need
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")
    return s.select("minutes", "m", i).select(
        "step", r(F.when(ok, F.greatest(F.col("m") * (F.lit(1.0) + F.col("step") * 0.1), F.lit(0.0))).otherwise(0.0)).alias("prediction"),
        F.when(ok, 0.8).otherwise(0.0).alias("confidence"),
        F.when(ok, "moving_average").otherwise("insufficient_data").alias("method"))


def rule_demand(df: DataFrame, hour: Column, area: str, top: int = 5) -> DataFrame:
    """50 x (1.5 in peak hours, else 0.8) x (1.2 in the busiest areas, else 0.9)."""
    from ..functions.calendar import is_peak

    best = (df.where(F.col(area).isNotNull()).groupBy(area).agg(F.count("*").alias("_n"))
            .orderBy(F.desc("_n"), area).limit(top).select(area, F.lit(True).alias("_top")))
    j = df.join(F.broadcast(best), area, "left")  # at most ``top`` rows
    expr = F.lit(50.0) * F.when(is_peak(hour), 1.5).otherwise(0.8) * F.when(F.col("_top"), 1.2).otherwise(0.9)
    return j.withColumn("prediction", r(expr)).drop("_top")
