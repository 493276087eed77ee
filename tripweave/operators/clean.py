"""Cleaning of trip tables: names, time, coordinates, gaps, repeats, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import calendar as cal
from ..functions.geo import in_city
from ..schema import RAW_TIME_FORMAT, RAW_TO_CANONICAL
from ..session import materialize, one_row
from .common import keep_first, modes, numeric_columns, q
from .quantile import exact_quantiles

ROW_ORDER = ("datetime", "base_station", "event_id")


def canonicalize(df: DataFrame) -> DataFrame:
    """Strip blanks from names, apply the canonical names, turn NaN into NULL."""
    out = []
    for f in df.schema.fields:
        name = f.name.strip()
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(RAW_TO_CANONICAL.get(name, name)))
    return df.select(*out)


def parse_datetime(df: DataFrame, column: str = "datetime", fmt: str = RAW_TIME_FORMAT) -> DataFrame:
    """Parse a text time; what cannot be parsed becomes NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        parsed = F.coalesce(F.try_to_timestamp(q(column), F.lit(fmt)), F.expr(f"try_cast(`{column}` AS TIMESTAMP)"))
        df = df.withColumn(column, parsed.cast("timestamp_ntz"))
    return df


def process_datetime(df: DataFrame, column: str = "datetime", fmt: str = RAW_TIME_FORMAT) -> DataFrame:
    df = parse_datetime(df, column, fmt)
    parts = cal.calendar_parts(column)
    new = {k: parts[k] for k in ("hour", "day", "weekday", "month", "quarter", "year")}
    new["date"] = F.to_date(column)
    new["is_weekend"] = cal.flag(F.weekday(column) >= 5)
    new["is_peak_hour"] = cal.flag(cal.is_peak(F.hour(column)))
    return df.withColumns(new)


def clean_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                      order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """City box, then one row per distinct coordinate."""
    return keep_first(df.where(in_city(F.col(lat), F.col(lon))), [lat, lon], [c for c in order if c in df.columns])


def handle_missing(df: DataFrame, required: Sequence[str] = ("datetime", "latitude", "longitude"),
                   mode_columns: Sequence[str] = ("base_station",)) -> DataFrame:
    """Drop rows without time or place; fill base by its mode, numbers by their median."""
    df = df.dropna(subset=[c for c in required if c in df.columns])
    nums = [c for c in numeric_columns(df) if c not in required]
    cats = [c for c in mode_columns if c in df.columns]
    nulls = one_row(df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in nums + cats]))
    nums = [c for c in nums if nulls[c]]
    cats = [c for c in cats if nulls[c]]
    fill: dict = {}
    if nums:
        fill.update({c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in nums}).items()})
    if cats:
        fill.update(modes(df, cats))
    return fill_columns(df, fill)


def fill_columns(df: DataFrame, fill: dict) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for c, v in fill.items():
        if v is None:
            continue
        kind = types[c]
        if isinstance(v, float) and isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) \
                and not v.is_integer():
            kind = T.DoubleType()
        new[c] = F.coalesce(q(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(new) if new else df


def remove_duplicates(df: DataFrame, keys: Sequence[str] = ("datetime", "latitude", "longitude"),
                      order: Sequence[str] = ("base_station", "event_id")) -> DataFrame:
    """Full-row copies go, then all but the first row per (time, place); one search serves both steps."""
    return keep_first(df, list(keys), [c for c in order if c in df.columns])


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str] = ("latitude", "longitude"),
                        low: float = 0.05, high: float = 0.95, k: float = 2.0) -> DataFrame:
    """Wide-fence trimming, one column after the other on the survivors."""
    for c in columns:
        a, b = exact_quantiles(df, {c: [low, high]})[c]
        if a is None:
            continue
        span = b - a
        df = df.where(q(c).between(a - k * span, b + k * span))
    return df


def remove_outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / population std below the threshold, column by column.

    Rows with a null in a column with spread go; a constant or empty column is passed over.
    """
    if columns is None:
        columns = [c for c in numeric_columns(df) if not cal.is_derived(c)]
    for c in columns:
        s = one_row(df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")))
        if not s["s"]:
            continue  # a column without spread has no outliers
        df = df.where(F.abs((q(c) - F.lit(s["m"])) / F.lit(s["s"])) < threshold)
    return df


def clean_generic(df: DataFrame, dedupe: bool = True, missing: str = "drop") -> DataFrame:
    """Distinct rows, then drop or fill the gaps."""
    if dedupe:
        df = df.distinct()
    if missing == "drop":
        return df.dropna()
    nums = numeric_columns(df)
    cols = df.columns if missing == "fill_mode" else nums
    nulls = one_row(df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in cols]))
    gaps = [c for c in cols if nulls[c]]
    if not gaps:
        return df
    if missing == "fill_mean":
        fill = one_row(df.agg(*[F.avg(q(c)).alias(c) for c in gaps]))
    elif missing == "fill_median":
        fill = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in gaps}).items()}
    elif missing == "fill_mode":
        fill = _typed_modes(df, gaps)
    else:
        raise ValueError(f"unknown way to treat gaps: {missing}")
    return fill_columns(df, fill)


def _typed_modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Mode of each column in its own type, so that ties compare as values; all columns in one job.

    Every column is a grouping set with one count per value; the largest count, then the least value, wins.
    """
    names = [f"c{i}" for i in range(len(columns))]
    cells = df.select(*[q(c).alias(n) for c, n in zip(columns, names)])
    counts = cells.groupingSets([[n] for n in names], *names).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    best = counts.where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()).groupBy("g").agg(
        F.min(F.struct((-F.col("n")).alias("n"), *names)).alias("b"))
    found = {c: None for c in columns}
    for row in best.collect():  # a row per column
        i = next(i for i, n in enumerate(names) if row["b"][n] is not None)
        found[columns[i]] = row["b"][names[i]]
    return found


def clean_all(df: DataFrame) -> DataFrame:
    """The whole cleaning: names, time, place, gaps, repeats, wide outliers.

    The two shuffles (one row per place, one row per time and place) are written
    out, since medians, modes and fences read their results several times.
    """
    df = materialize(clean_coordinates(process_datetime(canonicalize(df))), "clean-places")
    df = materialize(remove_duplicates(handle_missing(df)), "clean-single")
    return remove_outliers_iqr(df)


def remove_outliers_forest(df: DataFrame, columns: Sequence[str], key: str, contamination: float = 0.1) -> DataFrame:
    """Drop the most isolated share of the rows."""
    from .anomaly import drop_isolated

    return drop_isolated(df, columns, key, contamination)
