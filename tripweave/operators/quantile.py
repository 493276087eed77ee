"""Exact quantiles that do not gather a column in one task.

``percentile`` keeps every distinct value of a group in one hash map.  That is
the right tool up to some millions of rows.  Beyond it the wanted order
statistics are bracketed by an approximate sketch, the brackets are tightened
until few rows are left inside, and only those are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import one_row

DIRECT_LIMIT = 1_000_000
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]],
                    direct_limit: int = DIRECT_LIMIT) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of whole columns, NULLs left out.

    Returns one list per column, in the order of the asked probabilities.
    """
    cols = list(wanted)
    src = df.select(*[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(cols)])
    counts = one_row(src.agg(*[F.count(f"q{i}").alias(f"n{i}") for i in range(len(cols))]))
    sizes = [counts[f"n{i}"] for i in range(len(cols))]
    if max(sizes, default=0) <= direct_limit:
        row = one_row(src.agg(*[
            F.percentile(f"q{i}", F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(f"v{i}")
            for i, c in enumerate(cols)]))
        return {c: list(row[f"v{i}"]) if sizes[i] else [None] * len(wanted[c])
                for i, c in enumerate(cols)}
    return _bracketed(src, cols, wanted, sizes, direct_limit)


def _bracketed(src, cols, wanted, sizes, limit):
    # one bracket per (column, order statistic)
    marks: list[dict] = []
    for i, c in enumerate(cols):
        if not sizes[i]:
            continue
        ranks = set()
        for p in wanted[c]:
            h = (sizes[i] - 1) * p
            ranks |= {math.floor(h), math.ceil(h)}
        marks += [{"col": i, "k": k, "lo": -math.inf, "hi": math.inf, "below": 0, "inside": sizes[i]}
                  for k in sorted(ranks)]
    for _ in range(12):
        open_marks = [m for m in marks if m["inside"] > limit and m["lo"] < m["hi"]]
        if not open_marks:
            break
        shared: dict[tuple, list[dict]] = {}  # marks of one column and bracket ask one sketch
        for m in open_marks:
            shared.setdefault((m["col"], m["lo"], m["hi"]), []).append(m)
        aggs = []
        for j, ms in enumerate(shared.values()):
            at = [(m["k"] - m["below"]) / max(m["inside"] - 1, 1) for m in ms]
            ends = [x for q in at for x in (max(0.0, q - 2.0 / _ACCURACY), min(1.0, q + 2.0 / _ACCURACY))]
            aggs.append(F.percentile_approx(_inside(ms[0]), ends, _ACCURACY).alias(f"e{j}"))
        found = one_row(src.agg(*aggs))
        open_marks = [m for ms in shared.values() for m in ms]
        ends = [found[f"e{j}"][2 * i:2 * i + 2] for j, ms in enumerate(shared.values()) for i in range(len(ms))]
        tries = [dict(m, lo=lo, hi=hi) for m, (lo, hi) in zip(open_marks, ends)]
        checks = one_row(src.agg(*[x for j, t in enumerate(tries) for x in (
            F.count_if(F.col(f"q{t['col']}") < F.lit(t["lo"])).alias(f"b{j}"),
            F.count_if(F.col(f"q{t['col']}").between(t["lo"], t["hi"])).alias(f"i{j}"))]))
        for j, (m, t) in enumerate(zip(open_marks, tries)):
            b, n = checks[f"b{j}"], checks[f"i{j}"]
            # the sketch has a bounded rank error; keep the old bracket if it missed
            if b <= m["k"] < b + n:
                m.update(lo=t["lo"], hi=t["hi"], below=b, inside=n)
    # rank what is left inside the brackets; equal values are merged first
    pieces = F.array_compact(F.array(*[F.when(_inside(m).isNotNull(), F.struct(F.lit(j).alias("m"), _inside(m).alias("v")))
                                       for j, m in enumerate(marks)]))
    merged = (src.select(F.explode(pieces).alias("s")).select("s.m", "s.v")
              .groupBy("m", "v").agg(F.count("*").alias("n")))
    ks = F.create_map(*[x for j, m in enumerate(marks) for x in (F.lit(j), F.lit(m["k"] - m["below"]))])
    ranked = merged.withColumn("upto", F.sum("n").over(
        W.partitionBy("m").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    picked = (ranked.where(F.col("upto") > ks[F.col("m")]).groupBy("m").agg(F.min("v").alias("v")))
    values = {row["m"]: row["v"] for row in picked.collect()}  # one row per asked statistic
    stat = {(marks[j]["col"], marks[j]["k"]): v for j, v in values.items()}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        res: list[float | None] = []
        for p in wanted[c]:
            if not sizes[i]:
                res.append(None)
                continue
            h = (sizes[i] - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            a, b = stat[(i, lo)], stat[(i, hi)]
            res.append(a if lo == hi else a + (b - a) * (h - lo))
        out[c] = res
    return out


def _inside(m: dict):
    c = F.col(f"q{m['col']}")
    if m["lo"] == -math.inf:
        return c
    return F.when(c.between(m["lo"], m["hi"]), c)
