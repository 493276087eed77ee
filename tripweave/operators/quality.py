"""Checks, summaries and reports on data quality, all as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import r, ratio
from ..schema import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, RAW_TIME_FORMAT
from ..session import one_row
from .common import numeric_columns, q, row_groups, string_columns, tidy_stats, top_values, value_counts
from .quantile import exact_quantiles


def _name_value(df: DataFrame, items: dict[str, Column], name: str = "check_name", value: str = "check_value") -> DataFrame:
    """One-row frame -> rows (name, value)."""
    rows = F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in items.items()])
    return df.select(F.explode(rows).alias("s")).select("s.*")


def row_profile(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: total, repeats, NULLs per column, and weighted row counts of ``extra`` tests.

    Rows are grouped with their copies once; every figure is a sum over groups.
    """
    n = F.col("_n")
    aggs = [F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows")]
    aggs += [F.coalesce(F.sum(F.when(q(c).isNull(), n)), F.lit(0)).alias(f"missing:{c}") for c in df.columns]
    for k, test in (extra or {}).items():
        aggs.append(F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias(k))
    return row_groups(df).agg(*aggs)


def validate_cleaned(df: DataFrame, lat: str = "latitude", lon: str = "longitude", time: str = "datetime") -> DataFrame:
    out = ~(F.col(lat).between(LAT_MIN, LAT_MAX) & F.col(lon).between(LON_MIN, LON_MAX))
    prof = row_profile(df, {"outside": F.coalesce(out, F.lit(True)), "no_time": F.col(time).isNull()})
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    items = {"rows": F.col("rows"), "columns": F.lit(len(df.columns)).cast("long"),
             "duplicate_rows": F.col("duplicate_rows")}
    items |= {f"missing:{c}": q(f"missing:{c}") for c in df.columns}
    items |= {
        "coordinates_ok": F.when(F.col("outside") == 0, one).otherwise(zero),
        "datetime_ok": F.when(F.col("no_time") == 0, one).otherwise(zero),
        "issues": (F.col("outside") > 0).cast("long") + (F.col("no_time") > 0).cast("long")
        + (F.col("rows") == 0).cast("long") + (F.col("duplicate_rows") > 0).cast("long"),
    }
    return _name_value(prof, items)


def validate_raw(df: DataFrame, required: Sequence[str] = ("Date/Time", "Lat", "Lon", "Base")) -> DataFrame:
    """Checks on raw files: required columns, gaps, repeats, box, unreadable times."""
    have = set(df.columns)
    extra: dict[str, Column] = {}
    if "Lat" in have:
        extra["latitude_out_of_bounds"] = (F.col("Lat") < LAT_MIN) | (F.col("Lat") > LAT_MAX)
    if "Lon" in have:
        extra["longitude_out_of_bounds"] = (F.col("Lon") < LON_MIN) | (F.col("Lon") > LON_MAX)
    if "Date/Time" in have:
        t = q("Date/Time")
        extra["unreadable_times"] = t.isNotNull() & F.try_to_timestamp(t, F.lit(RAW_TIME_FORMAT)).isNull()
    prof = row_profile(df, extra)
    items = {"rows": F.col("rows"), "columns": F.lit(len(df.columns)).cast("long"),
             "duplicate_rows": F.col("duplicate_rows"),
             "missing_required_columns": F.lit(len([c for c in required if c not in have])).cast("long")}
    items |= {f"missing:{c}": q(f"missing:{c}") for c in df.columns}
    items |= {k: F.col(k) for k in extra}
    return _name_value(prof, items)


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, before, after, change, change_pct) for rows, columns, gaps, repeats."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        prof = row_profile(df)
        total = sum((q(f"missing:{c}") for c in df.columns), F.lit(0).cast("long"))
        items = {"rows": F.col("rows"), "columns": F.lit(len(df.columns)).cast("long"),
                 "missing": total, "duplicate_rows": F.col("duplicate_rows")}
        return _name_value(prof, items, "measure", tag)

    j = side(before, "before_value").join(side(after, "after_value"), "measure")
    gone = F.col("before_value") - F.col("after_value")
    return j.select("measure", "before_value", "after_value", gone.alias("removed"),
                    r(ratio(gone, F.col("before_value")) * 100).alias("removed_pct"),
                    (gone > 0).cast("int").alias("improved"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    cols = list(columns or numeric_columns(df))
    qs = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    base = tidy_stats(df, cols, {
        "n": F.count, "mean": lambda c: r(F.avg(c)), "std": lambda c: r(F.stddev_samp(c)),
        "min": lambda c: r(F.min(c).cast("double")), "max": lambda c: r(F.max(c).cast("double"))})
    return attach_constants(base, {"q25": {c: qs[c][0] for c in cols}, "median": {c: qs[c][1] for c in cols},
                                   "q75": {c: qs[c][2] for c in cols}})


def attach_constants(df: DataFrame, per_column: dict[str, dict[str, float | None]], key: str = "column_name") -> DataFrame:
    """Add known per-column numbers to a tidy table as literals."""
    new = {}
    for name, vals in per_column.items():
        e = F.lit(None).cast("double")
        for c, v in vals.items():
            e = F.when(F.col(key) == c, F.lit(v).cast("double")).otherwise(e)
        new[name] = r(e)
    return df.withColumns(new)


def data_summary(df: DataFrame) -> DataFrame:
    """Long table (column_name, stat, value): gaps, describe figures, distinct text values, top five."""
    nums, texts = numeric_columns(df), string_columns(df)
    d = describe(df, nums)
    stats = ["n", "mean", "std", "min", "q25", "median", "q75", "max"]
    num_part = d.unpivot("column_name", [F.col(s).cast("double").alias(s) for s in stats], "stat", "value")
    gaps = tidy_stats(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()).cast("double")})
    gap_part = gaps.select("column_name", F.lit("missing").alias("stat"), F.col("missing").alias("value"))
    vc = value_counts(df, texts)
    uniq = vc.groupBy("column_name").agg(F.count("*").cast("double").alias("value")).select(
        "column_name", F.lit("unique").alias("stat"), "value")
    tops = top_values(df, texts, 5).select(
        "column_name", F.concat(F.lit("top:"), "v").alias("stat"), F.col("n").cast("double").alias("value"))
    return num_part.unionByName(gap_part).unionByName(uniq).unionByName(tops)


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str, threshold: float) -> dict[str, tuple]:
    if method == "iqr":
        out = {}
        for c, (a, b) in exact_quantiles(df, {c: [0.25, 0.75] for c in columns}).items():
            out[c] = (None, None) if a is None else (a - threshold * (b - a), b + threshold * (b - a))
        return out
    if method == "zscore":
        s = one_row(df.agg(*[x for i, c in enumerate(columns) for x in (
            F.avg(q(c)).alias(f"m{i}"), F.stddev_samp(q(c)).alias(f"s{i}"))]))
        return {c: (s[f"m{i}"], s[f"s{i}"]) for i, c in enumerate(columns)}
    raise ValueError(f"unknown outlier method: {method}")


def _is_outlier(c: Column, bound: tuple, method: str, threshold: float) -> Column:
    a, b = bound
    if a is None or b is None or (method == "zscore" and not b):
        return F.lit(False)
    if method == "iqr":
        return (c < F.lit(a)) | (c > F.lit(b))
    return F.abs((c - F.lit(a)) / F.lit(b)) > threshold


def detect_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """(column_name, outlier_count, outlier_pct)."""
    bounds = outlier_bounds(df, columns, method, threshold)
    aggs = [F.count_if(_is_outlier(q(c), bounds[c], method, threshold)).alias(f"c{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("outlier_count"),
                              r(ratio(F.col(f"c{i}"), F.col("n")) * 100).alias("outlier_pct"))
                     for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def outlier_members(df: DataFrame, columns: Sequence[str], key: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """(column_name, key) of every outlying value."""
    bounds = outlier_bounds(df, columns, method, threshold)
    names = F.array(*[F.when(_is_outlier(q(c), bounds[c], method, threshold), F.lit(c)) for c in columns])
    return df.select(F.explode(F.array_compact(names)).alias("column_name"), key)


def summary_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: numeric figures or distinct count and mode."""
    cols = list(columns or df.columns)
    nums = [c for c in numeric_columns(df) if c in cols]
    cats = [c for c in cols if c not in nums]
    null_d, null_l, null_s = (F.lit(None).cast(t) for t in ("double", "long", "string"))

    def shape(d: DataFrame, kind: str) -> DataFrame:
        for c, v in {"mean": null_d, "median": null_d, "std": null_d, "min": null_d, "max": null_d, "q25": null_d,
                     "q75": null_d, "unique_values": null_l, "most_common": null_s,
                     "most_common_count": null_l}.items():
            if c not in d.columns:
                d = d.withColumn(c, v)
        return d.select("column_name", F.lit(kind).alias("kind"), "n", "missing",
                        r(ratio(F.col("missing"), F.col("n")) * 100).alias("missing_pct"), "mean", "median", "std",
                        "min", "max", "q25", "q75", "unique_values", "most_common", "most_common_count")

    counts = {"n": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(c.isNull())}
    parts = []
    if nums:
        qs = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in nums})
        d = tidy_stats(df, nums, counts | {
            "mean": lambda c: r(F.avg(c)), "std": lambda c: r(F.stddev_samp(c)),
            "min": lambda c: r(F.min(c).cast("double")), "max": lambda c: r(F.max(c).cast("double"))})
        d = attach_constants(d, {"q25": {c: qs[c][0] for c in nums}, "median": {c: qs[c][1] for c in nums},
                                 "q75": {c: qs[c][2] for c in nums}})
        parts.append(shape(d, "numeric"))
    if cats:
        d = tidy_stats(df, cats, counts)
        best = value_counts(df, cats).groupBy("column_name").agg(
            F.count("*").alias("unique_values"),
            F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
        best = best.select("column_name", "unique_values", F.col("b.v").alias("most_common"),
                           (-F.col("b.n")).alias("most_common_count"))
        d = d.join(best, "column_name", "left").withColumn(
            "unique_values", F.coalesce("unique_values", F.lit(0).cast("long")))
        parts.append(shape(d, "categorical"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_types(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column_name, expected_type, status, bad_values): non-null values that do not cast."""
    aggs, rows = [], []
    for i, (c, t) in enumerate(expected.items()):
        bad = F.lit(0).cast("long")
        if c in df.columns:
            aggs.append(F.count_if(q(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull()).alias(f"b{i}"))
            bad = F.col(f"b{i}")
        status = F.lit("missing") if c not in df.columns else F.when(bad == 0, "valid").otherwise("invalid")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("expected_type"),
                             status.alias("status"), bad.alias("bad_values")))
    one = df.agg(F.count("*").alias("n"), *aggs)
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


