"""Exact-size samples that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.common import q, row_index
from ..session import materialize, one_row


def hash_order(key: str, seed: int = 42) -> Column:
    """Pseudo-random but fixed order of rows by their key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), q(key).cast("string")))


def sample_random(df: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows (all rows if there are fewer) without replacement.

    On large inputs a hash threshold first thins every partition to about the
    wanted share, so that the final top-n moves little more than the sample.
    """
    h = hash_order(key, seed)
    total = df.count()
    if total <= size:
        return df
    pre = df
    if total > 4 * size:
        share = min(1.0, (size + 6 * math.sqrt(size) + 100) / total)
        cut = F.lit(format(int(share * 16**12), "012x"))
        thin = df.where(F.substring(h, 1, 12) <= cut)
        if thin.select(key).count() >= size:  # else keep the full input: the size must be exact
            pre = thin
    return pre.withColumn("_h", h).orderBy("_h", q(key)).limit(size).drop("_h")


def sample_systematic(df: DataFrame, size: int, key: str, small: int = 1_000_000) -> DataFrame:
    """Rows 0, step, 2*step ... in key order, step = rows // size, first ``size`` of them.

    Positions come from ``row_index``, which never sorts a large table in one task.
    """
    step = max(df.count() // size, 1)
    placed = row_index(df, [key], "_i", small)
    return placed.where((F.col("_i") % step == 0) & (F.col("_i") < F.lit(step * size))).drop("_i")


def sample_stratified(df: DataFrame, size: int, group: str, key: str, seed: int = 42, small: int = 1_000_000) -> DataFrame:
    """min(group size, size // groups) rows of every group, in hash order.

    On large inputs every group is first thinned to little more than its share by
    a hash threshold of its own, so the ranking sees few rows even of a group that
    holds a third of the table.  Should a threshold leave too few, which is very
    unlikely, all rows are ranked.
    """
    groups = materialize(df.groupBy(group).agg(F.count("*").alias("_n")), "strata")
    s = one_row(groups.agg(F.count("*").alias("g"), F.sum("_n").alias("n")))
    k = size // max(s["g"], 1)
    d = df.withColumn("_h", hash_order(key, seed))
    if (s["n"] or 0) > small:
        share = F.least(F.lit(1.0), F.lit(k + 6 * math.sqrt(k) + 100.0) / F.col("_n"))
        at = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(1 << 48)
        same = F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
        thin = d.alias("l").join(groups.alias("r"), same).where(at <= share).select("l.*", "_n")
        thin = materialize(thin, "strata-thin")
        kept = thin.groupBy(group).agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
        ok = one_row(kept.agg(F.count_if(F.col("_k") < F.least(F.lit(k), F.col("_n"))).alias("short"), F.count("*").alias("g")))
        if ok["short"] == 0 and ok["g"] == s["g"]:
            d = thin.drop("_n")
    w = W.partitionBy(group).orderBy("_h", q(key))
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_h", "_r")
