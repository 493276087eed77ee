"""Helpers shared by the operator modules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import materialize, one_row, small_side

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def q(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(names: Sequence[str]) -> str:
    """A prefix that no name has, for helper columns."""
    p = "_"
    while any(n.lower().startswith(p) for n in names):
        p += "_"
    return p


def tidy_stats(df: DataFrame, columns: Sequence[str], stats: dict, label: str = "column_name") -> DataFrame:
    """One aggregate pass over many columns, returned as one row per column.

    ``stats`` maps a result name to a function column -> aggregate.
    """
    aggs = [fn(q(c)).alias(f"a{i}_{s}") for i, c in enumerate(columns) for s, fn in stats.items()]
    rows = F.array(*[
        F.struct(F.lit(c).alias(label), *[F.col(f"a{i}_{s}").alias(s) for s in stats])
        for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("s")).select("s.*")


def long_form(df: DataFrame, columns: Sequence[str], kind: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (column_name, v) of several columns, NULLs left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast(kind).alias("v")) for c in columns])
    return (df.select(*keep, F.explode(cells).alias("s")).select(*keep, "s.column_name", "s.v")
            .where(F.col("v").isNotNull()))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, v, n) with map-side pre-aggregation."""
    return long_form(df, columns).groupBy("column_name", "v").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per column, ties by value.

    The rank filter lets Spark cut every partition to k rows before its shuffle.
    """
    w = W.partitionBy("column_name").orderBy(F.desc("n"), F.asc("v"))
    return value_counts(df, columns).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least one by ``order``; ties go by a hash of the other columns, equal rows count once.

    The winner is found on narrow rows (keys, order, hashes), in an aggregate that shrinks a hot key before its shuffle,
    and only for keys with several rows.  Whole rows then meet that written table: it is broadcast while small, else joined
    by a shuffled hash, so whole rows are never sorted, and those of a single key stay where they are.
    """
    names = df.columns
    rest = [q(c) for c in names if c not in keys and c not in order]
    mark = F.struct(*[q(c) for c in order], *([F.xxhash64(*rest), F.hash(*rest)] if rest else []), F.lit(0))
    p = free_prefix(names)
    found = df.groupBy(*[q(c).alias(f"{p}{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias(p + "n"), F.min(mark).alias(p + "w"))
    found = materialize(found.where(F.col(p + "n") > 1).drop(p + "n"), "first")
    same = reduce(lambda x, y: x & y, [q(c).eqNullSafe(F.col(f"{p}{i}")) for i, c in enumerate(keys)])
    met, first = df.join(small_side(found), same, "left"), F.col(p + "w")
    alone, several = met.where(first.isNull()), met.where(first.isNotNull()).where(mark == first)
    columns = [q(c) for c in names]
    return alone.select(*columns).unionByName(several.select(*columns).distinct())


def row_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies (``_n``)."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column as text, ties to the least value."""
    found = {r["column_name"]: r["v"] for r in top_values(df, columns, 1).collect()}  # a row per column
    return {c: found.get(c) for c in columns}


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-key table back to the rows it was made from.

    The table is written first, so the optimizer knows its size: a small one is
    broadcast and the rows stay where they are, a large one is joined by shuffle
    with skew splitting.
    """
    return df.join(materialize(table, "attach"), list(keys), how)


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, str], small: int = 1_000_000) -> DataFrame:
    """Running totals (own row included) in a total order, without one task for a large table.

    ``values`` maps a result name to the column that is summed.  Large tables are
    range partitioned: totals run within a partition, and the totals of all
    partitions before it, one row each, are added.
    """
    cols = [q(c) for c in order]
    df = materialize(df, "prefix-in")
    run = W.orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    if df.count() <= small:
        return df.withColumns({k: F.sum(q(c)).over(run) for k, c in values.items()})
    placed = materialize(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id()), "prefix")
    tot = placed.groupBy("_part").agg(*[F.sum(q(c)).alias(f"_t{i}") for i, c in enumerate(values.values())])
    # one row per range partition, far below the data
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = tot.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(values))])
    inner = W.partitionBy("_part").orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(starts), "_part").withColumns(
        {k: F.sum(q(c)).over(inner) + F.col(f"_s{i}") for i, (k, c) in enumerate(values.items())})
    return out.drop("_part", *[f"_s{i}" for i in range(len(values))])


def row_index(df: DataFrame, order: Sequence[str], name: str, small: int = 1_000_000) -> DataFrame:
    """0-based position in a total order."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(one, order, {name: "_one"}, small).withColumn(name, q(name) - 1).drop("_one")


def row_count(df: DataFrame) -> int:
    return one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
