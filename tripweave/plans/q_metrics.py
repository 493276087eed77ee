"""Queries: evaluation metrics over a deterministic prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.numbers import r
from ..operators import chartdata, metrics, series
from . import sqltext as S
from .registry import query


def predictions(spark, d):
    """Hourly demand as truth and the demand 24 hours before as prediction."""
    h = series.add_lags(series.hourly_counts(views.trips(spark, d)), "demand", [24], prefix="lag")
    return h.where("lag_24 is not null").select("hour", F.col("demand").cast("double").alias("y"), F.col("lag_24").cast("double").alias("yhat"))


def labelled(spark, d):
    """Document quality as truth; text length as score, a length rule as prediction."""
    docs = views.table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    j = views.table(spark, d, "labels").join(docs, "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 5 >= 2).cast("int").alias("yhat"),
                    F.col("n_chars").alias("score"), "lang")


_REG = """count(*) AS n, round(avg((y - yhat) * (y - yhat)), 6) AS mse, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
  round(avg(abs(y - yhat)), 6) AS mae, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2,
  round(1 - (sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted_r2,
  round(avg(abs(y - yhat) / nullif(y, 0)) * 100, 6) AS mape, round(median(abs(y - yhat) / nullif(y, 0)) * 100, 6) AS mape_robust,
  round(avg(2 * abs(y - yhat) / nullif(abs(y) + abs(yhat), 0)) * 100, 6) AS smape"""


@query("metrics_regression", S.P + f"SELECT {_REG} FROM predictions")
def metrics_regression(spark, d):
    return metrics.regression_metrics(predictions(spark, d))


_LAB = """WITH t AS (SELECT l.doc_id, quality AS y, (n_chars % 5 >= 2)::INT AS yhat, n_chars AS score, lang FROM labels l JOIN documents d USING (doc_id))"""
_CLS = """, k AS (SELECT c AS label, count(*) FILTER (y = c) AS support, count(*) FILTER (yhat = c) AS predicted, count(*) FILTER (y = c AND yhat = c) AS hit
    FROM t, (SELECT DISTINCT quality AS c FROM labels) GROUP BY 1),
  z AS (SELECT label, support, hit, coalesce(hit::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS rc FROM k),
  f AS (SELECT *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f1 FROM z)"""


@query("metrics_classification", _LAB + _CLS + """ SELECT round(sum(hit)::DOUBLE / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1_score, sum(support)::BIGINT AS n FROM f""")
def metrics_classification(spark, d):
    return metrics.classification_metrics(labelled(spark, d))


@query("confusion_matrix", _LAB + " SELECT y, yhat, count(*) AS n FROM t GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(labelled(spark, d))


@query("classification_report", _LAB + _CLS + " SELECT label, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def classification_report(spark, d):
    return metrics.class_report(labelled(spark, d)).select(
        "label", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"), "support")


@query("roc_auc", _LAB + """, x AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM t)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc,
  count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM x""")
def roc_auc(spark, d):
    return metrics.roc_auc(labelled(spark, d), "y", "score")


_LANGS = ("de", "en", "es", "fr")


@query("roc_auc_ovr", " UNION ALL ".join(f"""SELECT '{c}' AS label, round((sum(rk) FILTER (lang = '{c}') - count(*) FILTER (lang = '{c}') * (count(*) FILTER (lang = '{c}') + 1) / 2.0::DOUBLE)
  / nullif(count(*) FILTER (lang = '{c}') * count(*) FILTER (lang <> '{c}'), 0), 6) AS auc FROM (
  SELECT lang, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM (SELECT lang, n_chars % {7 + i} AS s FROM documents))"""
                                         for i, c in enumerate(_LANGS)))
def roc_auc_ovr(spark, d):
    t = views.table(spark, d, "documents").select("lang", *[(F.col("n_chars") % (7 + i)).alias(f"s_{c}") for i, c in enumerate(_LANGS)])
    return metrics.roc_auc_ovr(t, "lang", {c: f"s_{c}" for c in _LANGS})


@query("roc_curve", _LAB + """, g AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM t GROUP BY 1)
SELECT score AS threshold, round((sum(n) OVER w)::DOUBLE / (SELECT sum(n) FROM g), 6) AS fpr, round((sum(p) OVER w)::DOUBLE / (SELECT sum(p) FROM g), 6) AS tpr
FROM g WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark, d):
    return metrics.roc_curve(labelled(spark, d), "y", "score")


@query("metrics_timeseries", S.with_views("predictions") + f""",
d AS (SELECT y - lag(y) OVER (ORDER BY hour) AS dy, yhat - lag(yhat) OVER (ORDER BY hour) AS dp FROM predictions),
m AS (SELECT median(y - yhat) AS med FROM predictions),
a AS (SELECT round(median(abs(y - yhat - med)), 6) AS mad FROM predictions, m),
t AS (SELECT round(avg((sign(dy) = sign(dp))::INT), 6) AS direction_accuracy, round(corr(dy, dp), 6) AS trend_consistency FROM d WHERE dy IS NOT NULL)
SELECT * FROM (SELECT {_REG} FROM predictions), a, t""")
def metrics_timeseries(spark, d):
    return metrics.time_series_metrics(predictions(spark, d))


@query("metrics_business", S.P + """SELECT round(avg(CASE WHEN yhat > y THEN (yhat - y) / nullif(y, 0) ELSE 0 END) * 100, 6) AS overestimation_penalty,
  round(avg(CASE WHEN yhat < y THEN (y - yhat) / nullif(y, 0) ELSE 0 END) * 100, 6) AS underestimation_penalty, round(avg(yhat - y), 6) AS bias,
  round(stddev_pop(yhat), 6) AS prediction_stability FROM predictions""")
def metrics_business(spark, d):
    return metrics.business_metrics(predictions(spark, d))


@query("metrics_financial", S.P + """SELECT round(sum(greatest(0, y - yhat)), 4) AS revenue_loss, round(sum(greatest(0, yhat - y)), 4) AS cost_overrun,
  round(sum(greatest(0, y - yhat)) + sum(greatest(0, yhat - y)), 4) AS total_financial_impact FROM predictions""")
def metrics_financial(spark, d):
    return metrics.financial_metrics(predictions(spark, d))


@query("metrics_operational", S.P + """SELECT round(avg((abs((yhat - y) / nullif(y, 0)) <= 0.1)::INT), 6) AS accuracy_within_tolerance,
  round(1 - stddev_pop(dp) / avg(yhat), 6) AS prediction_consistency FROM (SELECT *, yhat - lag(yhat) OVER (ORDER BY hour) AS dp FROM predictions)""")
def metrics_operational(spark, d):
    return metrics.operational_metrics(predictions(spark, d))


_MODELS = (1, 24, 168)
_RANKED = ("mse", "mae", "smape", "r2")


@query("model_ranking", S.with_views("base_hourly") + """,
p AS (""" + " UNION ALL ".join(f"""SELECT base_station, 'lag_{k}' AS model, demand::DOUBLE AS y,
    lag(demand, {k}) OVER (PARTITION BY base_station ORDER BY hour)::DOUBLE AS yhat FROM base_hourly""" for k in _MODELS) + """),
m AS (SELECT base_station, model, round(avg((y - yhat) * (y - yhat)), 6) AS mse, round(avg(abs(y - yhat)), 6) AS mae,
  round(avg(2 * abs(y - yhat) / nullif(abs(y) + abs(yhat), 0)) * 100, 6) AS smape, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2
  FROM p WHERE yhat IS NOT NULL GROUP BY 1, 2),
u AS (UNPIVOT m ON mse, mae, smape, r2 INTO NAME metric VALUE value)
SELECT base_station, model, metric, value, rank() OVER (PARTITION BY base_station, metric ORDER BY k) + (count(*) OVER (PARTITION BY base_station, metric, k) - 1) / 2.0::DOUBLE AS rank
FROM (SELECT *, CASE WHEN metric = 'r2' THEN -value ELSE value END AS k FROM u)""")
def model_ranking(spark, d):
    h = series.add_lags(series.hourly_counts(views.trips(spark, d), ["base_station"]), "demand", _MODELS, ["base_station"], prefix="lag")
    long = h.unpivot(["base_station", "hour", "demand"], [f"lag_{k}" for k in _MODELS], "model", "yhat").where("yhat is not null")
    long = long.select("base_station", "model", F.col("demand").cast("double").alias("y"), F.col("yhat").cast("double").alias("yhat"))
    aggs = metrics.regression_aggregates()
    scores = long.groupBy("base_station", "model").agg(*[r(aggs[m]).alias(m) for m in _RANKED])
    return metrics.rank_models(scores, _RANKED, series=["base_station"])


@query("importance_concentration", """WITH i AS (SELECT p_brand AS f, sum(p_retailprice) AS v FROM part GROUP BY 1),
a AS (SELECT v, row_number() OVER (ORDER BY f) AS pos, row_number() OVER (ORDER BY v, f) AS k, count(*) OVER () AS n FROM i)
SELECT round(sum(v), 4) AS total_importance, round(avg(v), 6) AS mean_importance, round(stddev_samp(v), 6) AS std_importance, count(*) AS feature_count,
  round(sum((2 * k - n - 1) * v) / (any_value(n) * sum(v)), 6) AS gini_coefficient, round(sum(v) FILTER (pos <= 5), 4) AS top_5_importance,
  round(sum(v) FILTER (pos <= 10), 4) AS top_10_importance, round(sum(v) FILTER (pos <= 5) / sum(v), 6) AS concentration_ratio FROM a""")
def importance_concentration(spark, d):
    t = views.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("importance"))
    return metrics.importance_summary(t, "p_brand")


@query("residuals", S.P + "SELECT hour, y, yhat, y - yhat AS residual FROM predictions")
def residuals(spark, d):
    return metrics.residuals(predictions(spark, d))


@query("residual_histogram", S.with_views("predictions") + """, x AS (SELECT y - yhat AS v FROM predictions), e AS (SELECT min(v) a, max(v) b FROM x)
SELECT s.bin::INT AS bin, round(a + s.bin * ((b - a) / 30), 6) AS bin_left, round(a + (s.bin + 1) * ((b - a) / 30), 6) AS bin_right, coalesce(n, 0) AS n
FROM e CROSS JOIN range(30) s(bin) LEFT JOIN (
  SELECT least(floor(round((v - a) / (b - a) * 30, 9)), 29)::INT AS bin, count(*) AS n FROM x, e GROUP BY 1) h ON h.bin = s.bin""")
def residual_histogram(spark, d):
    return chartdata.histogram(metrics.residuals(predictions(spark, d)), "residual", 30)


@query("qq_points")
def qq_points(spark, d):
    return metrics.qq_points(metrics.residuals(predictions(spark, d)), "residual", "hour")


@query("prob_histogram", _LAB + """, x AS (SELECT y, score::DOUBLE / (SELECT max(score) FROM t) AS p FROM t), e AS (SELECT min(p) a, max(p) b FROM x)
SELECT g.y, s.bin::INT AS bin, round(a + s.bin * ((b - a) / 30), 6) AS bin_left, round(a + (s.bin + 1) * ((b - a) / 30), 6) AS bin_right, coalesce(n, 0) AS n
FROM e CROSS JOIN range(30) s(bin) CROSS JOIN (SELECT DISTINCT y FROM x) g LEFT JOIN (
  SELECT y, least(floor(round((p - a) / (b - a) * 30, 9)), 29)::INT AS bin, count(*) AS n FROM x, e GROUP BY 1, 2) h ON h.bin = s.bin AND h.y = g.y""")
def prob_histogram(spark, d):
    t = labelled(spark, d)
    top = t.agg(F.max("score")).scalar()
    return chartdata.histogram(t.withColumn("p", F.col("score").cast("double") / top), "p", 30, "y")
