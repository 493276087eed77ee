"""Exploratory aggregates: counts, patterns, pivots, correlations, data quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import calendar as cal
from ..functions.numbers import r, r_mean, ratio
from ..session import one_row
from .common import (long_form, numeric_columns, q, row_groups, string_columns, tidy_stats, top_values,
                     value_counts)
from .quality import attach_constants, describe
from .quantile import exact_quantiles

PATTERN_KEYS = {"hour": F.hour, "day": F.dayofmonth, "week": F.weekofyear, "month": F.month}


def pattern_stats(df: DataFrame, by: str, value: str = "value", time: str = "datetime") -> DataFrame:
    """count, mean, std, min, max of a value per hour / day / ISO week / month."""
    return df.groupBy(PATTERN_KEYS[by](time).alias(by)).agg(
        F.count(value).alias("n"), r_mean(F.avg(value), 2).alias("mean"), r(F.stddev_samp(value), 2).alias("std"),
        r(F.min(value), 2).alias("min"), r(F.max(value), 2).alias("max"))


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def day_type_hours(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Rows per (day type, hour), the mean over hours per type, and weekend / weekday."""
    cells = df.groupBy(F.when(F.weekday(time) >= 5, "weekend").otherwise("weekday").alias("day_type"),
                       F.hour(time).alias("hour")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    # at most 48 rows reach these windows
    per_type = W.partitionBy("day_type")
    every = W.partitionBy(F.lit(1))
    mean = F.avg("n").over(per_type)
    c = cells.withColumn("type_mean", mean)
    share = ratio(F.max(F.when(F.col("day_type") == "weekend", F.col("type_mean"))).over(every),
                  F.max(F.when(F.col("day_type") == "weekday", F.col("type_mean"))).over(every))
    return c.select("day_type", "hour", "n", r(F.col("type_mean")).alias("type_mean"), r(share).alias("weekend_ratio"))


def peak_shares(df: DataFrame, time: str = "datetime") -> DataFrame:
    """(kind, label, n, pct) of peak periods, peak hours and weekends, in one scan."""
    from pyspark.sql import Window as W

    h = F.hour(time)
    d = df.select(cal.peak_label(h).alias("a"), cal.flag(cal.is_peak(h)).cast("string").alias("b"),
                  cal.flag(F.weekday(time) >= 5).cast("string").alias("c"))
    g = d.groupBy("a", "b", "c").agg(F.count("*").alias("n"))  # a handful of rows
    kinds = F.array(F.struct(F.lit("peak_period").alias("kind"), F.col("a").alias("label")),
                    F.struct(F.lit("is_peak_hour").alias("kind"), F.col("b").alias("label")),
                    F.struct(F.lit("is_weekend").alias("kind"), F.col("c").alias("label")))
    t = g.select(F.explode(kinds).alias("k"), "n").groupBy("k.kind", "k.label").agg(F.sum("n").alias("n"))
    return t.withColumn("pct", r(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("kind"))))


def pivot_hours(df: DataFrame, row: Column, name: str, time: str = "datetime", value: str | None = None) -> DataFrame:
    """Rows of ``name`` by 24 hour columns h0..h23: counts (0 if empty) or means (NULL if empty)."""
    d = df.select(row.alias(name), F.hour(time).alias("_h"), *([value] if value else []))
    p = d.groupBy(name).pivot("_h", list(range(24)))
    if value is None:
        out = p.agg(F.count(F.lit(1))).na.fill(0)
    else:
        out = p.agg(r_mean(F.avg(value)))
    return out.select(name, *[q(str(h)).alias(f"h{h}") for h in range(24)])


def key_metrics(df: DataFrame, distance: str | None = None, time: str = "datetime") -> DataFrame:
    peak, weekend = cal.is_peak(F.hour(time)).cast("int"), (F.weekday(time) >= 5).cast("int")
    return df.agg(F.count("*").alias("total_orders"),
                  (r_mean(F.avg(distance)) if distance else F.lit(None).cast("double")).alias("avg_distance"),
                  r(F.avg(peak) * 100).alias("peak_pct"), r(F.avg(weekend) * 100).alias("weekend_pct"))


def basic_analysis(df: DataFrame, base: str = "base_station") -> DataFrame:
    """Long table (item, value): shape, span, ranges, bases."""
    secs = F.unix_timestamp(F.max("datetime").cast("timestamp")) - F.unix_timestamp(F.min("datetime").cast("timestamp"))
    one = df.agg(F.count("*").cast("double").alias("rows"), F.lit(float(len(df.columns))).alias("columns"),
                 F.floor(secs / 86400).cast("double").alias("span_days"),
                 r(F.min("latitude")).alias("lat_min"), r(F.max("latitude")).alias("lat_max"),
                 r(F.min("longitude")).alias("lon_min"), r(F.max("longitude")).alias("lon_max"))
    part = one.unpivot([], one.columns, "item", "value")
    bases = df.where(F.col(base).isNotNull()).groupBy(base).agg(F.count("*").cast("double").alias("value"))
    dist = bases.select(F.concat(F.lit("base:"), base).alias("item"), "value")
    uniq = bases.agg(F.count("*").cast("double").alias("value")).select(F.lit("unique_bases").alias("item"), "value")
    return part.unionByName(dist).unionByName(uniq)


def temporal_counts(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Counts per hour, weekday, month and peak flag: four groupings, one scan."""
    d = df.select(F.hour(time).alias("hour"), F.weekday(time).alias("weekday"), F.month(time).alias("month"),
                  cal.flag(cal.is_peak(F.hour(time))).alias("is_peak_hour"))
    keys = ["hour", "weekday", "month", "is_peak_hour"]
    g = d.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # grouping_id has a 1 for every key that is not part of the set
    kind = F.lit("hour")
    for i, k in enumerate(keys):
        kind = F.when(F.col("g") == 15 - (8 >> i), F.lit(k)).otherwise(kind)
    return g.select(kind.alias("kind"), F.coalesce(*keys).alias("k"), "n")


def peak_rows(counts: DataFrame) -> DataFrame:
    """Three peak and off-peak hours, busiest and quietest weekday; ties to the lower key.

    ``counts`` has (kind, k, n) for hours and weekdays: at most 31 rows reach the windows.
    """
    from pyspark.sql import Window as W

    g = counts.where(F.col("kind").isin("hour", "weekday"))
    g = g.withColumns({"up": F.row_number().over(W.partitionBy("kind").orderBy("n", "k")),
                       "down": F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "k"))})
    hour, day = F.col("kind") == "hour", F.col("kind") == "weekday"
    kinds = F.array_compact(F.array(
        F.when(hour & (F.col("down") <= 3), F.lit("peak_hour")), F.when(hour & (F.col("up") <= 3), F.lit("off_peak_hour")),
        F.when(day & (F.col("down") == 1), F.lit("busiest_day")), F.when(day & (F.col("up") == 1), F.lit("quietest_day"))))
    return g.select(F.explode(kinds).alias("kind"), "k", "n")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(item, value): rows, columns, repeated rows, distinct values per column (exact)."""
    vals = distinct_values(df)
    shape = row_groups(df).agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"),
                               F.lit(len(df.columns)).cast("long").alias("columns"))
    return shape.unpivot([], ["rows", "duplicate_rows", "columns"], "item", "value").unionByName(
        vals.select(F.concat(F.lit("unique:"), "column_name").alias("item"), "value"))


BITS_PER_ROW = 128  # a bitmap is used where its bits are at most so many times the rows


def distinct_values(df: DataFrame) -> DataFrame:
    """(column_name, value): the number of distinct values of every column, nulls left out; exact.

    Whole numbers that lie dense enough set bits in bitmaps, which merge before the shuffle.  All other cells are grouped in
    their own type, one shuffle per type, so 0.0 and -0.0 are one value, as are all NaN.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kind = {"byte": "bigint", "short": "bigint", "integer": "bigint", "long": "bigint", "float": "double"}.get(
            f.dataType.typeName(), f.dataType.simpleString())
        kinds.setdefault(kind, []).append(f.name)
    whole = kinds.pop("bigint", [])
    span = one_row(df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(whole) for x in (
        F.min(q(c)).cast("long").alias(f"a{i}"), F.max(q(c)).cast("long").alias(f"b{i}"))]))
    low = {c: span[f"a{i}"] for i, c in enumerate(whole)
           if span[f"a{i}"] is not None and span[f"b{i}"] - span[f"a{i}"] <= BITS_PER_ROW * span["n"]}
    parts = [df.sparkSession.createDataFrame([(c, 0) for c in df.columns], "column_name string, value bigint")]
    if low:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), (q(c).cast("long") - F.lit(a)).alias("v")) for c, a in low.items()])
        bits = df.select(F.explode(cells).alias("s")).select("s.*").where("v IS NOT NULL")
        maps = bits.groupBy("column_name", F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m"))
        parts.append(maps.groupBy("column_name").agg(F.sum(F.bitmap_count("m")).alias("value")))
    rest = [c for c in whole if c not in low]
    for kind, cols in (({"bigint": rest} if rest else {}) | kinds).items():
        seen = long_form(df, cols, kind).groupBy("column_name", "v").agg(F.lit(1).alias("_"))
        parts.append(seen.groupBy("column_name").agg(F.count("*").alias("value")))
    return reduce(DataFrame.unionByName, parts).groupBy("column_name").agg(F.sum("value").alias("value"))


def missing_table(df: DataFrame) -> DataFrame:
    t = tidy_stats(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()), "n": lambda c: F.count(F.lit(1))})
    return t.select("column_name", "missing", r(ratio(F.col("missing"), F.col("n")) * 100).alias("missing_pct"))


def numeric_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """describe plus bias-corrected skewness and kurtosis and the interquartile range."""
    cols = list(columns or numeric_columns(df))
    d = describe(df, cols)
    g = tidy_stats(df, cols, {"g1": F.skewness, "g2": F.kurtosis, "m": F.count})
    n = F.col("m").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    g = g.select("column_name", r(skew, 5).alias("skewness"), r(kurt, 5).alias("kurtosis"))
    return d.join(F.broadcast(g), "column_name").withColumn("iqr", r(F.col("q75") - F.col("q25")))  # a row per column


def categorical_shape(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column_name, item, v, n): top k values, the rarest one and the number of distinct ones."""
    cols = list(columns or string_columns(df))
    tops = top_values(df, cols, k).select("column_name", F.concat(F.lit("top"), F.col("rk").cast("string")).alias("item"), "v", "n")
    ends = value_counts(df, cols).groupBy("column_name").agg(
        F.count("*").alias("u"), F.min(F.struct("n", "v")).alias("least"))
    return (tops.unionByName(ends.select("column_name", F.lit("unique").alias("item"), F.lit(None).cast("string").alias("v"),
                                         F.col("u").alias("n")))
            .unionByName(ends.select("column_name", F.lit("least").alias("item"), "least.v", "least.n")))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair i < j, all pairs in one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(q(a).cast("double"), q(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), r(F.col(f"c{k}")).alias("correlation"))
                     for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def strong_correlations(df: DataFrame, columns: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Pairs with |r| above the limit; every row carries the mean r of all pairs."""
    c = correlations(df, columns)
    mean = c.agg(r(F.avg("correlation"), 5).alias("m")).scalar()
    return c.where(F.abs("correlation") > limit).withColumn("avg_correlation", mean)


def outlier_table(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    qs = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    lo = {c: None if a is None else a - k * (b - a) for c, (a, b) in qs.items()}
    hi = {c: None if a is None else b + k * (b - a) for c, (a, b) in qs.items()}
    aggs = []
    for i, c in enumerate(columns):
        bad = F.lit(False) if lo[c] is None else (q(c) < F.lit(lo[c])) | (q(c) > F.lit(hi[c]))
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(q(c)).cast("double").alias(f"a{i}"), F.max(q(c)).cast("double").alias(f"b{i}")]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("outlier_count"),
        r(ratio(F.col(f"n{i}"), F.col("n")) * 100).alias("outlier_pct"),
        r(F.col(f"a{i}")).alias("min_value"), r(F.col(f"b{i}")).alias("max_value")) for i, c in enumerate(columns)])
    t = one.select(F.explode(rows).alias("s")).select("s.*")
    return attach_constants(t, {"lower_bound": lo, "upper_bound": hi})


def quality_score(df: DataFrame) -> DataFrame:
    """One row: score 0..100, its three parts and the advice flags."""
    n = F.col("_n")
    texts = string_columns(df)
    gaps = sum((F.when(q(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    aggs = [F.sum(n).alias("rows"), F.sum(n - 1).alias("dups"), F.sum(gaps * n).alias("gaps")]
    aggs += [F.count_if(q(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()).alias(f"t{i}") for i, c in enumerate(texts)]
    one = row_groups(df).agg(*aggs)
    k = len(df.columns)
    mixed = sum(((F.col(f"t{i}") == 0).cast("int") for i in range(len(texts))), F.lit(0))
    miss = ratio(F.col("gaps"), F.col("rows") * k) * 100
    dup = ratio(F.col("dups"), F.col("rows")) * 100
    cut = (F.when(miss > 10, 20).when(miss > 5, 10).otherwise(0) + F.when(dup > 5, 15).when(dup > 1, 5).otherwise(0)
           + F.when(mixed > 0, 10).otherwise(0))
    score = F.greatest(F.lit(0), F.lit(100) - cut)
    return one.select(
        score.cast("long").alias("score"), r(miss).alias("missing_pct"), r(dup).alias("duplicate_pct"),
        (F.lit(k) - mixed).cast("long").alias("consistent_columns"), (score < 80).cast("int").alias("advise_cleaning"),
        (F.col("gaps") > 0).cast("int").alias("advise_fill"), (F.col("dups") > 0).cast("int").alias("advise_dedupe"),
        (score >= 90).cast("int").alias("ready"))


def quality_ratios(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness (mean share of distinct values), consistency (share of unrepeated rows)."""
    n = F.col("_n")
    k = len(df.columns)
    gaps = sum((F.when(q(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    one = row_groups(df).agg(F.sum(n).alias("rows"), F.sum(n - 1).alias("dups"), F.sum(gaps * n).alias("gaps"))
    uniq = distinct_values(df).agg(F.sum("value").alias("u")).scalar()
    return one.select(r(F.lit(1.0) - ratio(F.col("gaps"), F.col("rows") * k)).alias("completeness"),
                      r(ratio(uniq, F.col("rows") * k)).alias("uniqueness"),
                      r(F.lit(1.0) - ratio(F.col("dups"), F.col("rows"))).alias("consistency"))


def cluster_popularity(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(cluster, n, pct, kind): rows of each cluster; kind names the most and the least popular one, ties to the lower label."""
    sizes = df.where(q(label).isNotNull()).groupBy(q(label).alias("cluster")).agg(F.count("*").alias("n"))
    ends = sizes.agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("top"), F.min(F.struct("n", F.col("cluster").alias("c"))).alias("low"),
                     F.sum("n").alias("rows"))
    one = ends.select(F.struct("*").alias("e")).scalar()
    kind = F.when(F.col("cluster") == -one["top"]["c"], "most_popular").when(F.col("cluster") == one["low"]["c"], "least_popular").otherwise("cluster")
    return sizes.select("cluster", "n", r(F.col("n") * 100.0 / one["rows"]).alias("pct"), kind.alias("kind"))


def as_sections(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack tidy tables of any shape as (section, row, item, value)."""
    out = None
    for name, df in parts.items():
        keys = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        rest = [c for c in df.columns if c not in keys]
        label = F.concat_ws("/", *[F.coalesce(q(c), F.lit("")) for c in keys]) if keys else F.lit("")
        t = df.select(label.alias("label"), *[q(c).cast("string").alias(c) for c in rest])
        t = t.unpivot(["label"], rest, "item", "value").select(F.lit(name).alias("section"), "label", "item", "value")
        out = t if out is None else out.unionByName(t)
    return out
