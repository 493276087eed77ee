"""Alerts from a row of running statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import ALERT

# metric -> (limit, direction); a low availability is bad, so it alerts below its limit
THRESHOLDS: dict[str, tuple[float, str]] = {
    "high_demand": (50.0, "above"),
    "high_wait_time": (10.0, "above"),
    "low_vehicle_availability": (0.3, "below"),
}
Rule = Callable[[DataFrame], DataFrame]


def alert_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT.fields])


def threshold_alerts(stats: DataFrame, thresholds: Mapping[str, tuple[float, str]] = THRESHOLDS) -> DataFrame:
    """One alert per crossed limit; high when it is crossed by half as much again."""
    have = [m for m in thresholds if m in stats.columns]
    rows = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(thresholds[m][0])).alias("threshold"),
        F.lit(thresholds[m][1]).alias("direction")) for m in have])
    t = stats.select("as_of", F.explode(rows).alias("s")).select("as_of", "s.*")
    v, lim = F.col("value"), F.col("threshold")
    up = F.col("direction") == "above"
    t = t.where(F.when(up, v > lim).otherwise(v < lim)).withColumns({
        "type": F.lit("threshold_exceeded"),
        "severity": F.when(F.when(up, v > lim * 1.5).otherwise(v < lim / 1.5), "high").otherwise("medium")})
    return alert_columns(t)


def anomaly_alerts(stats: DataFrame, demand: float = 50, wait: float = 10, need: int = 20) -> DataFrame:
    """High demand in 10 minutes, long waits, demand surge; silent below ``need`` events."""
    def one(kind: str, metric: str, value, limit, hit, level):
        return F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                                    F.lit(limit).cast("double").alias("threshold"), level.alias("severity")))

    n, w = F.col("recent_10"), F.col("avg_wait_time")
    rows = F.array_compact(F.array(
        one("high_demand", "recent_10", n, demand, n > demand, F.when(n > 2 * demand, F.lit("high")).otherwise(F.lit("medium"))),
        one("high_wait_time", "avg_wait_time", w, wait, w > wait, F.lit("high")),
        one("demand_surge", "recent_30", F.col("recent_30"), None, F.col("demand_surge") == 1, F.lit("high"))))
    t = stats.where(F.col("buffered") >= need).select("as_of", F.explode(rows).alias("s")).select("as_of", "s.*")
    return alert_columns(t)


def apply_rules(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alerts of user rules, each a function from the statistics to alert rows."""
    out = None
    for rule in rules:
        a = alert_columns(rule(stats))
        out = a if out is None else out.unionByName(a)
    return out if out is not None else stats.sparkSession.createDataFrame([], ALERT)


def active_alerts(alerts: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Alerts younger than ``hours`` before ``as_of`` (default: the latest alert)."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else alerts.agg(F.max("as_of")).scalar()
    return alerts.where(F.col("as_of") > now - F.expr(f"INTERVAL {int(hours)} HOURS"))
