"""Demand models on MLlib: features, fit, metrics, ensembles, validation, storage."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import hour_start
from ..functions.numbers import r
from ..session import in_parallel, materialize, scratch_path, spread
from .encode import hash_share, mark_test
from .metrics import regression_aggregates

NUMERIC = ("hour", "day_of_week", "month", "lat_mean", "lon_mean")
LABEL = "demand"


def demand_table(df: DataFrame, keys: Sequence[str] = (), time: str = "datetime") -> DataFrame:
    """Demand per hour (and key) with calendar parts and mean place: one aggregate."""
    g = df.groupBy(*keys, hour_start(time).alias("hour_date")).agg(
        F.count("*").alias("demand"), F.avg("latitude").alias("lat_mean"), F.avg("longitude").alias("lon_mean"))
    return g.withColumns({"hour": F.hour("hour_date"), "day_of_week": F.weekday("hour_date"),
                          "month": F.month("hour_date"), "date": F.to_date("hour_date")})


def row_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def prepare(df: DataFrame, keys: Sequence[str], share: float = 0.2) -> DataFrame:
    """Written once: model table with a row key and a fixed train/test mark.

    It is dealt by row key to files for all cores: learners scan it thousands of times, and one file is read by one task.
    """
    d = mark_test(df.withColumn("row_key", row_key(keys)), F.col("row_key"), share)
    return materialize(spread(d, "row_key").sortWithinPartitions("row_key"), "model-table")


def regressor(name: str, **kw):
    """linear, random_forest, gbt_xgb, gbt_lgb with the usual defaults."""
    if name == "linear":
        return LinearRegression(labelCol=LABEL, featuresCol="features", **kw)
    if name == "random_forest":
        args = {"numTrees": 100, "maxDepth": 10, "seed": 42} | kw
        return RandomForestRegressor(labelCol=LABEL, featuresCol="features", **args)
    if name == "gbt_xgb":
        args = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42} | kw
        return GBTRegressor(labelCol=LABEL, featuresCol="features", **args)
    if name == "gbt_lgb":
        args = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "maxBins": 128, "subsamplingRate": 0.8, "seed": 42} | kw
        return GBTRegressor(labelCol=LABEL, featuresCol="features", **args)
    raise ValueError(f"unknown model: {name}")


def pipeline(reg, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = ()) -> Pipeline:
    """Codes, median fill, assembly and scaling are fitted with the model, on the training rows."""
    stages: list = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_idx" for c in categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}_num" for c in numeric]))
    inputs = [f"{c}_num" for c in numeric] + [f"{c}_idx" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="assembled"))
    stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, reg])


def as_double(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in [*numeric, LABEL] if c in df.columns})


def fit(table: DataFrame, name: str, categorical: Sequence[str] = (), numeric: Sequence[str] = NUMERIC, **kw) -> PipelineModel:
    train = as_double(table.where("not is_test"), numeric)
    return pipeline(regressor(name, **kw), numeric, categorical).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], numeric: Sequence[str] = NUMERIC,
          out: str = "prediction") -> DataFrame:
    """Predictions with their row keys; all preparation comes from the fitted pipeline."""
    return model.transform(as_double(df, numeric)).select(*keep, F.col("prediction").alias(out))


def split_metrics(pred: DataFrame, model: str, yhat: str = "prediction") -> DataFrame:
    """(model, split, n, r2, rmse, mae) for train and test rows, in one pass."""
    a = regression_aggregates(LABEL, yhat)
    return pred.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("split")).agg(
        a["n"].alias("n"), r(a["r2"]).alias("r2"), r(a["rmse"]).alias("rmse"), r(a["mae"]).alias("mae")).select(
        F.lit(model).alias("model"), "*")


def train_and_measure(table: DataFrame, name: str, categorical: Sequence[str] = (), **kw) -> DataFrame:
    m = fit(table, name, categorical, **kw)
    return split_metrics(score(m, table, ["row_key", "is_test", LABEL]), name)


def compare(table: DataFrame, specs: dict[str, dict], categorical: Sequence[str] = ()) -> DataFrame:
    """Metric rows of every model that can be fitted, with its rank by test r2."""
    from pyspark.sql import Window as W

    rows = in_parallel(lambda spec: train_and_measure(table, spec[0], categorical, **spec[1]), specs.items())
    out = reduce(DataFrame.unionByName, rows)
    wide = out.groupBy("model").pivot("split", ["train", "test"]).agg(
        F.first("r2").alias("r2"), F.first("rmse").alias("rmse"), F.first("mae").alias("mae"))
    return wide.withColumn("rank", F.rank().over(W.orderBy(F.desc("test_r2"))))  # a row per model


def importances(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str], spark) -> DataFrame:
    """(feature, importance): tree importances or absolute coefficients; a row per feature."""
    last = model.stages[-1]
    vals = last.featureImportances if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients]
    names = [*numeric, *categorical]
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(vals[i])).alias("importance")) for i, n in enumerate(names)])
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def weighted_vote(df: DataFrame, columns: Sequence[str], weights: Sequence[float] | None = None, out: str = "prediction") -> DataFrame:
    """Weighted mean of prediction columns that stand side by side; equal weights by default."""
    w = list(weights or [1.0] * len(columns))
    total = sum(w)
    expr = F.lit(0.0)
    for c, x in zip(columns, w):
        expr = expr + F.col(c) * F.lit(x)
    return df.withColumn(out, expr / F.lit(total))


def ensemble(table: DataFrame, specs: dict[str, dict], categorical: Sequence[str] = (), weights: Sequence[float] | None = None) -> DataFrame:
    """All models are fitted at a time; each scores the same rows in turn, so no join of outputs is needed."""
    fitted = in_parallel(lambda spec: fit(table, spec[0], categorical, **spec[1]), specs.items())
    d = as_double(table)
    keep = d.columns
    for name, m in zip(specs, fitted):
        d = m.transform(d).select(*keep, F.col("prediction").alias(f"p_{name}"))
        keep = d.columns
    return weighted_vote(d, [f"p_{n}" for n in specs], weights)


def ensemble_of(fitted: Sequence[PipelineModel], df: DataFrame, keep: Sequence[str], numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """The predictions p0, p1, ... of fitted models side by side, each row scored by all of them in turn."""
    d = as_double(df, numeric)
    cols = d.columns
    for k, m in enumerate(fitted):
        d = m.transform(d).select(*cols, F.col("prediction").alias(f"p{k}"))
        cols = d.columns
    return d.select(*keep, *[f"p{k}" for k in range(len(fitted))])


def cross_validate(table: DataFrame, name: str, folds: int = 5, categorical: Sequence[str] = (), **kw) -> DataFrame:
    """Test r2 per fold (folds by key hash) and their mean, population std, min and max."""
    d = as_double(materialize(table.withColumn("fold", F.floor(hash_share(F.col("row_key"), 7) * folds).cast("int")), "folds"))

    def one(k: int) -> DataFrame:
        m = pipeline(regressor(name, **kw), categorical=categorical).fit(d.where(F.col("fold") != k))
        a = regression_aggregates(LABEL, "prediction")
        return m.transform(d.where(F.col("fold") == k)).agg(a["r2"].alias("r2")).select(F.lit(k).alias("fold"), "r2")

    out = reduce(DataFrame.unionByName, in_parallel(one, range(folds)))
    s = out.agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"), F.min("r2").alias("min"), F.max("r2").alias("max"))
    tail = s.unpivot([], ["mean", "std", "min", "max"], "item", "r2")
    return out.select(F.concat(F.lit("fold"), "fold").alias("item"), "r2").unionByName(tail)


# The grids of the usual parameter search, 81 combinations each.  MLlib's trees end at depth 30, which stands for
# no limit, and know no least size of a split, in whose place the share of rows per tree varies.
FOREST_GRID = {"numTrees": (50, 100, 200), "maxDepth": (10, 20, 30), "minInstancesPerNode": (1, 2, 4), "subsamplingRate": (0.6, 0.8, 1.0)}
BOOST_GRID = {"maxIter": (100, 200, 300), "maxDepth": (3, 6, 9), "stepSize": (0.01, 0.1, 0.2), "subsamplingRate": (0.8, 0.9, 1.0)}


def grid_search(table: DataFrame, name: str, grid: dict[str, Sequence], folds: int = 5, categorical: Sequence[str] = (),
                parallelism: int = 4, out: str | None = None, **kw) -> DataFrame:
    """(params, mse, folds): mean squared error of every parameter combination over hash folds.

    A job is one combination and one fold; it writes its error to ``out`` when it is done.  A search that is run again on the
    same ``out`` fits only the jobs that are missing there.
    """
    spark = table.sparkSession
    out = out or scratch_path(spark, "grid")
    d = as_double(materialize(table.withColumn("fold", F.floor(hash_share(F.col("row_key"), 7) * folds).cast("int")), "folds"))
    combos = [dict(zip(grid, vs)) for vs in product(*grid.values())]
    shape = "params string, fold int, mse double, n bigint"

    def results() -> DataFrame:
        try:
            return spark.read.schema(shape).parquet(f"{out}/jobs")
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], shape)

    done = {(r["params"], r["fold"]) for r in results().select("params", "fold").collect()}  # a row per job
    jobs = [(c, k) for c in combos for k in range(folds) if (str(c), k) not in done]

    def one(job: tuple[dict, int]) -> None:
        params, k = job
        m = pipeline(regressor(name, **(kw | params)), categorical=categorical).fit(d.where(F.col("fold") != k))
        gap = F.col(LABEL) - F.col("prediction")
        err = m.transform(d.where(F.col("fold") == k)).agg(F.avg(gap * gap).alias("mse"), F.count("*").alias("n"))
        place = f"{out}/jobs/job={hashlib.md5(f'{params} {k}'.encode()).hexdigest()}"
        err.select(F.lit(str(params)).alias("params"), F.lit(k).alias("fold"), "mse", "n").coalesce(1).write.mode("overwrite").parquet(place)

    in_parallel(one, jobs, parallelism)
    wanted = results().where(F.col("params").isin([str(c) for c in combos]))
    return wanted.groupBy("params").agg(F.avg("mse").alias("mse"), F.count_if(F.col("n") > 0).alias("folds"))


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}
