"""Queries: time-series analysis and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.numbers import r, r_mean
from ..operators import explore, features, forecast, series
from ..session import materialize
from . import sqltext as S
from .registry import query

_B = ["base_station"]


def _hours(spark, d, keys=_B):
    h = series.hourly_counts(views.trips(spark, d), keys)
    return h.withColumn("y", F.col("demand").cast("double")).drop("demand")


_W = "(PARTITION BY base_station ORDER BY hour"


@query("seasonal_decompose", S.with_views("base_hourly") + f""",
a AS (SELECT *, demand::DOUBLE AS y, row_number() OVER {_W}) - 1 AS i, count(*) OVER (PARTITION BY base_station) AS n FROM base_hourly),
b AS (SELECT *, CASE WHEN i >= 12 AND i < n - 12 THEN ((sum(y) OVER {_W} ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING))
   + 0.5 * lag(y, 12) OVER {_W}) + 0.5 * lead(y, 12) OVER {_W})) / 24 END AS ma FROM a),
f AS (SELECT base_station, regr_slope(ma, i) FILTER (i < 36) AS s1, regr_intercept(ma, i) FILTER (i < 36) AS c1,
   regr_slope(ma, i) FILTER (i >= n - 36) AS s2, regr_intercept(ma, i) FILTER (i >= n - 36) AS c2 FROM b WHERE ma IS NOT NULL GROUP BY 1),
t AS (SELECT b.*, CASE WHEN i < 12 THEN s1 * i + c1 WHEN i >= n - 12 THEN s2 * i + c2 ELSE ma END AS trend FROM b JOIN f USING (base_station)),
p AS (SELECT base_station, i % 24 AS ph, avg(y - trend) AS v FROM t GROUP BY 1, 2),
g AS (SELECT base_station, ph, v - avg(v) OVER (PARTITION BY base_station) AS seasonal FROM p)
SELECT t.base_station, hour, y AS observed, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(y - trend - seasonal, 5) AS resid
FROM t JOIN g ON g.base_station = t.base_station AND g.ph = t.i % 24""")
def seasonal_decompose(spark, d):
    return features.rounded(forecast.decompose(_hours(spark, d), _B), 5)


@query("autocorrelation", S.with_views("base_hourly") + """,
x AS (SELECT base_station, row_number() OVER (PARTITION BY base_station ORDER BY hour) AS i, demand - avg(demand) OVER (PARTITION BY base_station) AS x FROM base_hourly),
v AS (SELECT base_station, sum(x * x) AS c0 FROM x GROUP BY 1)
SELECT a.base_station, k::INT AS lag, round(sum(a.x * b.x) / any_value(c0), 6) AS acf FROM range(0, 51) l(k) JOIN x a ON true
  JOIN x b ON b.base_station = a.base_station AND b.i = a.i + k JOIN v ON v.base_station = a.base_station GROUP BY 1, 2""")
def autocorrelation(spark, d):
    return features.rounded(forecast.autocorrelation(_hours(spark, d), _B))


@query("partial_autocorrelation")
def partial_autocorrelation(spark, d):
    return forecast.partial_autocorrelation(forecast.autocorrelation(_hours(spark, d), _B), _B)


@query("stationarity")
def stationarity(spark, d):
    return forecast.stationarity(_hours(spark, d), _B)


@query("arima_forecast")
def arima_forecast(spark, d):
    return forecast.arima_forecast(_hours(spark, d), _B)


@query("seasonal_forecast")
def seasonal_forecast(spark, d):
    return forecast.additive_forecast(materialize(_hours(spark, d, []), "hourly"))


@query("seasonal_forecast_fit")
def seasonal_forecast_fit(spark, d):
    from ..operators.metrics import regression_metrics

    f = forecast.additive_forecast(materialize(_hours(spark, d, []), "hourly"))
    return regression_metrics(f.where("not is_future"))


@query("daily_forecast")
def daily_forecast(spark, d):
    orders = views.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").cast("double").alias("y"))
    return forecast.additive_forecast(materialize(orders, "daily"), "y", "day", 7, "DAY", daily=0)


@query("forecast_compare")
def forecast_compare(spark, d):
    return forecast.forecast_errors(forecast.backtest(_hours(spark, d), _B), _B)


@query("forecast_backtest", S.with_views("base_hourly") + """,
o AS (SELECT *, row_number() OVER (PARTITION BY base_station ORDER BY hour) AS i, count(*) OVER (PARTITION BY base_station) AS n FROM base_hourly)
SELECT base_station, hour, model, demand::DOUBLE AS y, 0 AS far_off FROM o, (VALUES ('arima'), ('additive')) m(model)
WHERE i > floor(n * 0.8) AND floor(n * 0.8) >= 30""")
def forecast_backtest(spark, d):
    """The forecasts themselves; far_off counts those that are further from the series than ten times its largest value."""
    f = forecast.backtest(_hours(spark, d), _B)
    top = f.agg(F.max("y")).scalar()
    return f.select("base_station", "hour", "model", "y", (~(F.abs("yhat") <= 10 * F.greatest(top, F.lit(1.0)))).cast("int").alias("far_off"))


@query("forecast_trend")
def forecast_trend(spark, d):
    return forecast.forecast_trend(forecast.arima_forecast(_hours(spark, d), _B), _B)


@query("forecast_trend_history", S.with_views("base_hourly") + """
SELECT base_station, CASE WHEN arg_max(demand, hour) > arg_min(demand, hour) THEN 'up' ELSE 'down' END AS trend,
  min(demand)::DOUBLE AS low, max(demand)::DOUBLE AS high FROM base_hourly GROUP BY 1""")
def forecast_trend_history(spark, d):
    return forecast.forecast_trend(_hours(spark, d).withColumnRenamed("y", "yhat"), _B)


@query("short_term_forecast", S.with_views("trips") + """,
m AS (SELECT date_trunc('minute', datetime) AS minute, count(*) AS n FROM trips GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM m) AS k, (SELECT avg(n) FROM (SELECT n FROM m ORDER BY minute DESC LIMIT 5)) AS v)
SELECT s::INT AS step, round(CASE WHEN k >= 5 THEN greatest(0, v * (1 + 0.1::DOUBLE * s)) ELSE 0 END, 6) AS prediction,
  CASE WHEN k >= 5 THEN 0.8::DOUBLE ELSE 0 END AS confidence, CASE WHEN k >= 5 THEN 'moving_average' ELSE 'insufficient_data' END AS method FROM a, range(5) t(s)""")
def short_term_forecast(spark, d):
    return forecast.short_term_forecast(views.trips(spark, d).select("event_id", "datetime"))


@query("rule_demand", S.with_views("trips") + f""",
b AS (SELECT pickup_area FROM trips GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT event_id, round(50 * CASE WHEN {S.PEAK} THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END
  * CASE WHEN pickup_area IN (SELECT pickup_area FROM b) THEN 1.2::DOUBLE ELSE 0.9::DOUBLE END, 6) AS prediction FROM trips""")
def rule_demand(spark, d):
    t = views.trips(spark, d).select("event_id", "datetime", "pickup_area")
    return forecast.rule_demand(t, F.hour("datetime"), "pickup_area").select("event_id", "prediction")


@query("temporal_report")
def temporal_report(spark, d):
    t = views.trips(spark, d)
    h = materialize(_hours(spark, d), "report-hours")
    span = t.agg(F.min("datetime").cast("string").alias("start"), F.max("datetime").cast("string").alias("end"),
                 F.count("*").cast("string").alias("n"), F.min("value").cast("string").alias("min"), F.max("value").cast("string").alias("max"),
                 r_mean(F.avg("value")).cast("string").alias("mean"), r(F.stddev_samp("value")).cast("string").alias("std"))
    peak = explore.pattern_stats(t, "hour").orderBy(F.desc("mean"), "hour").limit(1).select(F.col("hour").alias("peak_hour"))
    return explore.as_sections({
        "span": span.unpivot([], span.columns, "name", "value").select("name", F.col("value").alias("label")).withColumn("x", F.lit(1)),
        "peak": peak, "stationarity": forecast.stationarity(h, _B),
        "autocorrelation": forecast.autocorrelation(h, _B), "models": forecast.forecast_errors(forecast.backtest(h, _B), _B),
        "trend": forecast.forecast_trend(forecast.arima_forecast(h, _B), _B)})
