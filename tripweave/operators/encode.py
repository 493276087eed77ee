"""Encoding, scaling, splitting and selection of model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import is_derived
from ..session import one_row
from .common import modes, numeric_columns, q, string_columns
from .clean import fill_columns
from .features import label_encode
from .quantile import exact_quantiles


def encode_categorical(df: DataFrame, columns: Sequence[str] | None = None, one_hot_limit: int = 10) -> DataFrame:
    """Sorted label code per text column (missing counts as 'Unknown'), and one-hot
    columns with one for missing where there are few values."""
    columns = list(columns or string_columns(df))
    values = {c: [row["v"] for row in df.where(q(c).isNotNull()).select(q(c).alias("v")).distinct()
                  .orderBy("v").limit(one_hot_limit + 1).collect()] for c in columns}  # at most limit + 1 each
    for c in columns:
        filled = df.withColumn("_f", F.coalesce(q(c), F.lit("Unknown")))
        df = label_encode(filled, "_f", f"{c}_encoded").drop("_f")
    new: dict[str, Column] = {}
    for c in columns:
        if len(values[c]) <= one_hot_limit:
            for v in values[c]:
                new[f"{c}_{v}"] = F.coalesce(q(c) == F.lit(v), F.lit(False)).cast("int")
            new[f"{c}_nan"] = q(c).isNull().cast("int")
    return df.withColumns(new) if new else df


def scale(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """``<col>_scaled``: standard, robust or minmax; a column without spread becomes 0."""
    columns = [c for c in (columns or numeric_columns(df)) if not is_derived(c)]
    if method == "robust":
        shift_by = {c: (v[1], (v[2] - v[0]) if v[0] is not None else None)
                    for c, v in exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}).items()}
    else:
        pair = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[method]
        s = one_row(df.agg(*[x for i, c in enumerate(columns) for x in (
            pair[0](q(c)).cast("double").alias(f"a{i}"), pair[1](q(c)).cast("double").alias(f"b{i}"))]))
        shift_by = {c: (s[f"a{i}"], s[f"b{i}"]) for i, c in enumerate(columns)}
    return df.withColumns({f"{c}_scaled": (q(c) - F.lit(a)) / F.lit(b or 1.0)
                           for c, (a, b) in shift_by.items() if a is not None})


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their sorted codes, missing by -1."""
    for c in columns:
        df = label_encode(df, c, f"{c}__code", missing=-1).drop(c).withColumnRenamed(f"{c}__code", c)
    return df


def fill_for_model(df: DataFrame) -> DataFrame:
    """Numbers by their median, texts by their mode, only where something is missing."""
    nums, texts = numeric_columns(df), string_columns(df)
    nulls = one_row(df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in nums + texts]))
    fill: dict = {}
    gaps = [c for c in nums if nulls[c]]
    if gaps:
        fill.update({c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in gaps}).items()})
    gaps = [c for c in texts if nulls[c]]
    if gaps:
        fill.update(modes(df, gaps))
    return fill_columns(df, fill)


def hash_share(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random number in [0, 1) per key, the same on every run and engine."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / float(1 << 32)


def mark_test(df: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for about ``share`` of the rows; independent of partitioning."""
    return df.withColumn("is_test", hash_share(key, seed) < share)


def select_by_correlation(df: DataFrame, target: str, columns: Sequence[str], threshold: float = 0.01) -> DataFrame:
    return _select(df, {c: F.abs(F.corr(q(c).cast("double"), q(target).cast("double"))) for c in columns}, threshold)


def select_by_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> DataFrame:
    return _select(df, {c: F.var_pop(F.coalesce(q(c).cast("double"), F.lit(0.0))) for c in columns}, threshold)


def _select(df: DataFrame, scores: dict[str, Column], threshold: float) -> DataFrame:
    one = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(scores.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"s{i}").alias("score")) for i, n in enumerate(scores)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where(F.col("score") > threshold)
