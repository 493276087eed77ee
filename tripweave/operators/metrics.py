"""Evaluation of predictions: plain aggregates over (y, yhat) or (y, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import normal_quantile, r, ratio
from .common import prefix_sums, q
from .quantile import exact_quantiles

ERROR_METRICS = ("mse", "rmse", "mae", "mape", "mape_robust", "smape")


def regression_aggregates(y: str = "y", yhat: str = "yhat", median_ape: Column | None = None) -> dict[str, Column]:
    """Named aggregates; rows with y = 0 have no relative error and are left out of mape."""
    e = F.col(y) - F.col(yhat)
    n = F.count(e).cast("double")
    mse = F.avg(e * e)
    r2 = F.lit(1.0) - ratio(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), F.col(y))) * n)
    out = {
        "n": F.count(e),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(e)),
        "r2": r2,
        "adjusted_r2": F.lit(1.0) - ratio((F.lit(1.0) - r2) * (n - 1), n - 2),
        "mape": F.avg(F.abs(ratio(e, F.col(y)))) * 100,
        "smape": F.avg(ratio(F.abs(e) * 2, F.abs(F.col(y)) + F.abs(F.col(yhat)))) * 100,
    }
    if median_ape is not None:
        out["mape_robust"] = median_ape
    return out


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: mse, rmse, mae, r2, adjusted r2, mape, median ape, smape."""
    ape = df.select(F.abs(ratio(F.col(y) - F.col(yhat), F.col(y))).alias("a"))
    med = exact_quantiles(ape, {"a": [0.5]})["a"][0]
    aggs = regression_aggregates(y, yhat, F.max(F.lit(med).cast("double") * 100))
    return df.agg(*[(c if k == "n" else r(c)).alias(k) for k, c in aggs.items()])


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is 0."""
    c = confusion(df, y, yhat)
    # each cell counts for its true class and for its predicted class
    sides = c.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    p = F.coalesce(ratio(F.col("hit"), F.col("predicted")), zero)
    rc = F.coalesce(ratio(F.col("hit"), F.col("support")), zero)
    f1 = F.coalesce(ratio(p * rc * 2, p + rc), zero)
    return g.select("label", p.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support", "hit")


def classification_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1."""
    rep = class_report(df, y, yhat)
    s = F.sum("support")
    w = lambda c: r(F.sum(F.col(c) * F.col("support")) / s)
    return rep.agg(r(F.sum("hit") / s).alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"),
                   w("f1").alias("f1_score"), s.alias("n"))


def score_counts(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """Positives and negatives per distinct score."""
    hit = F.col(y) == F.lit(positive)
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, positive=1, small: int = 1_000_000) -> DataFrame:
    """Area under the ROC curve by ranks: share of (positive, negative) pairs in right order, ties half."""
    c = prefix_sums(score_counts(df, y, score, positive), ["score"], {"neg_upto": "neg"}, small)
    good = F.col("pos") * (F.col("neg_upto") - F.col("neg") * 0.5)
    return c.agg(r(ratio(F.sum(good), F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"),
                 F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def roc_auc_ovr(df: DataFrame, y: str, scores: dict, small: int = 1_000_000) -> DataFrame:
    """(label, auc) one class against the rest; ``scores`` maps a class to its score column."""
    out = None
    for label, col in scores.items():
        one = roc_auc(df, y, col, label, small).select(F.lit(label).alias("label"), "auc")
        out = one if out is None else out.unionByName(one)
    return out


def roc_curve(df: DataFrame, y: str, score: str, positive=1, small: int = 1_000_000) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, scores at or above it taken as positive."""
    c = score_counts(df, y, score, positive).withColumn("down", -F.col("score"))
    c = prefix_sums(c, ["down"], {"tp": "pos", "fp": "neg"}, small)
    tot = score_counts(df, y, score, positive).agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    return c.select(F.col("score").alias("threshold"), r(ratio(F.col("fp"), tot["n"])).alias("fpr"),
                    r(ratio(F.col("tp"), tot["p"])).alias("tpr"))


def time_series_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", order: str = "hour") -> DataFrame:
    """Regression metrics plus median absolute deviation, direction accuracy, correlation of changes.

    ``df`` is an hourly table; its one window covers calendar hours, not trips.
    """
    base = regression_metrics(df, y, yhat)
    res = df.select((F.col(y) - F.col(yhat)).alias("e"))
    med = exact_quantiles(res, {"e": [0.5]})["e"][0]
    mad = exact_quantiles(res.select(F.abs(F.col("e") - F.lit(med)).alias("a")), {"a": [0.5]})["a"][0]
    w = W.orderBy(order)
    d = df.select((F.col(y) - F.lag(y).over(w)).alias("dy"), (F.col(yhat) - F.lag(yhat).over(w)).alias("dp")).where("dy is not null")
    trend = d.agg(r(F.avg((F.signum("dy") == F.signum("dp")).cast("int"))).alias("direction_accuracy"),
                  r(F.corr("dy", "dp")).alias("trend_consistency"))
    # one row each
    t = trend.select(F.struct("*").alias("t")).scalar()
    return base.select("*", r(F.lit(mad).cast("double")).alias("mad"), t["direction_accuracy"].alias("direction_accuracy"),
                       t["trend_consistency"].alias("trend_consistency"))


def business_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    up = F.col(yhat) - F.col(y)
    return df.agg(r(F.avg(F.when(up > 0, ratio(up, F.col(y))).otherwise(0.0)) * 100).alias("overestimation_penalty"),
                  r(F.avg(F.when(up < 0, ratio(-up, F.col(y))).otherwise(0.0)) * 100).alias("underestimation_penalty"),
                  r(F.avg(up)).alias("bias"), r(F.stddev_pop(yhat)).alias("prediction_stability"))


def financial_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    up = F.col(yhat) - F.col(y)
    zero = F.lit(0.0)
    return df.agg(r(F.sum(F.greatest(zero, -up)), 4).alias("revenue_loss"), r(F.sum(F.greatest(zero, up)), 4).alias("cost_overrun"),
                  r(F.sum(F.abs(up)), 4).alias("total_financial_impact"))


def operational_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", order: str = "hour", tolerance: float = 0.1) -> DataFrame:
    """Share within the tolerance, and 1 - std of changes / mean of the prediction (hourly table)."""
    d = df.withColumn("_d", F.col(yhat) - F.lag(yhat).over(W.orderBy(order)))
    rel = F.abs(ratio(F.col(yhat) - F.col(y), F.col(y)))
    return d.agg(r(F.avg((rel <= tolerance).cast("int"))).alias("accuracy_within_tolerance"),
                 r(F.lit(1.0) - ratio(F.stddev_pop("_d"), F.avg(yhat))).alias("prediction_consistency"))


def rank_models(scores: DataFrame, metrics: Sequence[str], model: str = "model", series: Sequence[str] = ()) -> DataFrame:
    """(series, model, metric, value, rank): average rank of ties, errors rise, all else falls.

    ``scores`` has one row per series and model, so the windows see a few rows each.
    """
    t = scores.unpivot([*series, model], list(metrics), "metric", "value").where("value is not null")
    key = F.when(F.col("metric").isin(*ERROR_METRICS), F.col("value")).otherwise(-F.col("value"))
    w = W.partitionBy(*series, "metric").orderBy("_k")
    ties = F.count("*").over(W.partitionBy(*series, "metric", "_k"))
    return t.withColumn("_k", key).withColumn("rank", F.rank().over(w) + (ties - 1) / 2.0).drop("_k")


def importance_summary(df: DataFrame, order: str, value: str = "importance", small: int = 1_000_000) -> DataFrame:
    """Sum, mean, std, sums of the first 5 and 10 in the given order, concentration, Gini."""
    d = df.select(q(order).alias("o"), q(value).alias("v"))
    first = prefix_sums(d.withColumn("_one", F.lit(1).cast("long")), ["o"], {"pos": "_one"}, small)
    by_size = prefix_sums(d.withColumn("_one", F.lit(1).cast("long")), ["v", "o"], {"pos": "_one"}, small)
    top = first.agg(F.struct(F.sum(F.when(F.col("pos") <= 5, F.col("v"))).alias("t5"),
                             F.sum(F.when(F.col("pos") <= 10, F.col("v"))).alias("t10")).alias("t")).scalar()
    n, total = F.count("*").cast("double"), F.sum("v")
    gini = ratio(F.sum(F.col("pos") * F.col("v")) * 2 - (n + 1) * total, n * total)
    return by_size.agg(r(total, 4).alias("total_importance"), r(F.avg("v")).alias("mean_importance"), r(F.stddev_samp("v")).alias("std_importance"),
                       F.count("*").alias("feature_count"), r(gini).alias("gini_coefficient"), total.alias("_t")).select(
        "*", r(top["t5"], 4).alias("top_5_importance"), r(top["t10"], 4).alias("top_10_importance"),
        r(ratio(top["t5"], F.col("_t"))).alias("concentration_ratio")).drop("_t")


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def qq_points(df: DataFrame, value: str, key: str, small: int = 1_000_000) -> DataFrame:
    """Sorted values against normal quantiles at Filliben's median positions."""
    d = df.select(q(key).alias("key"), q(value).alias("value")).where("value is not null")
    pos = prefix_sums(d.withColumn("_one", F.lit(1).cast("long")), ["value", "key"], {"i": "_one"}, small).drop("_one")
    n = d.agg(F.count("*").alias("n")).scalar().cast("double")
    i = F.col("i").cast("double")
    end = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == n, end).when(i == 1, F.lit(1.0) - end).otherwise((i - 0.3175) / (n + 0.365))
    return pos.select("key", "value", "i", p.alias("p")).withColumn("theoretical", r(normal_quantile(F.col("p")))).withColumn("p", r(F.col("p")))
