"""Mixing sources to target weights: budgets flow down a tree, every leaf gives a prefix of seeded epochs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import numbered

NEW = {"domain": "__domain", "n_tokens": "__tokens", "full_epochs": "__full", "last_tokens": "__last"}
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def weight_of(name: str, weights: dict[str, int]) -> Column:
    """The weight of a node by its name, 1 if it has none."""
    if not weights:
        return F.lit(1)
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(weights.items())))
    return F.coalesce(F.element_at(pairs, F.col(name)), F.lit(1))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget``: each parent's ``given`` tokens by weight, no node above its ``cap``.

    What full nodes cannot take goes to their siblings in proportion to their weights, until the budget is spent or all
    are full.  Whole tokens; what rounding leaves goes to the largest fractions, ties by name.  Nodes of weight 0 get
    nothing.
    """
    siblings = Window.partitionBy(*parent)
    fill = siblings.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.where("w > 0 AND cap > 0").withColumns({
        "before": F.coalesce(F.sum("cap").over(fill), F.lit(0)),
        "rest_w": F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(fill), F.lit(0)),
    })
    n = n.withColumn("full", F.col("cap") <= F.col("w") * ((F.col("given") - F.col("before")) / F.col("rest_w")))
    n = n.withColumns({
        "left": F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings),
        "open_w": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings),
    })
    n = n.withColumn("exact", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("left") / F.col("open_w"))))
    n = n.withColumn("whole", F.least(F.floor("exact"), F.col("cap")))
    spare = F.least(F.col("given"), F.sum("cap").over(siblings)) - F.sum("whole").over(siblings)
    n = n.withColumns({"spare": spare, "k": F.row_number().over(siblings.orderBy(F.col("full"), (F.col("whole") - F.col("exact")), name))})
    budget = F.col("whole") + F.when((F.col("k") <= F.col("spare")) & ~F.col("full"), 1).otherwise(0)
    return n.withColumn("budget", budget).drop("before", "rest_w", "full", "left", "open_w", "exact", "whole", "spare", "k", "given")


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """(domain, lang, source, supply, budget) of the leaves of the tree domain - language - source.

    ``leaves`` has the supply of each leaf; a leaf can give it ``epochs`` times.  A node's capacity is the sum of its
    leaves', so that a shortage is made up by siblings first and reaches an ancestor's siblings only if a whole subtree is
    exhausted.
    """
    leaves = leaves.withColumn("cap", F.col("supply") * epochs)
    levels = ["domain", "lang", "source"]
    given = leaves.select(F.lit(total).cast("bigint").alias("given")).limit(1).withColumn("root", F.lit(0))
    parent = ["root"]
    for k, level in enumerate(levels):
        keys = ["root", *levels[:k]]
        nodes = leaves.withColumn("root", F.lit(0)).groupBy(*keys, level).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("w", weight_of(level, weights.get(level, {}))).join(given, keys)
        given = share_out(nodes, parent, level).select(*keys, level, F.col("budget").alias("given"), "supply")
        if k < len(levels) - 1:
            given = given.drop("supply")
        parent = [*keys, level]
    return given.select("domain", "lang", "source", "supply", F.col("given").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: float = 1.0, epochs: int = 2,
        seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """Documents of the mixture: the columns ``keep`` of ``docs`` (default all), domain, n_tokens, full_epochs and last_tokens.

    The budget is ``share`` of all tokens (words).  Each leaf's documents are put in an order of their own in each epoch,
    by MD5 of seed, epoch and doc_id; the leaf takes whole epochs and then a prefix of the next one, whose last document
    may be cut: ``last_tokens`` of it count.  Rows that give no token are left out: empty and null texts, documents
    behind the prefix.  Null names are the node '' of their level; a column of ``docs`` named like a new one gives way to it; rows are counted one by one, repeated or not.  No
    window spans a leaf: prefix sums go over 4096 slices of the order and within the slice that the budget cuts.
    """
    given = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    plain = numbered(docs, "doc_id", "lang", "source", "text").columns
    names = dict(zip(docs.columns, plain))
    kept = [names[c] for c in given]
    every = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(*every, F.coalesce(domain, F.lit(""))).toDF(*plain, "__domain").withColumns(
        {"__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit("")), "__tokens": token_count()})
    rows = materialize(rows.select(*dict.fromkeys([*kept, "doc_id", "__domain", "__lang", "__source", "__tokens"])), "tokens")
    leaf = ["__domain", "__lang", "__source"]
    supply = rows.groupBy(*(F.col(c).alias(c[2:]) for c in leaf)).agg(F.sum("__tokens").alias("supply"))
    supply = materialize(supply.where("supply > 0"), "supply")
    total = supply.agg(F.coalesce(F.floor(F.sum("supply") * share), F.lit(0))).first()[0]
    plan = materialize(budgets(supply, int(total), weights, epochs), "budgets").where("budget > 0")
    plan = plan.select(*(F.col(c[2:]).alias(c) for c in leaf), F.floor(F.col("budget") / F.col("supply")).alias("__full"),
                       (F.col("budget") % F.col("supply")).alias("__rest"))
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("__full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.where("__tokens > 0").join(plan, leaf).withColumn("__at", at).withColumn("__slice", F.substring("__at", 1, 3))
    slices = placed.groupBy(*leaf, "__slice").agg(F.sum("__tokens").alias("__size"))
    upto = Window.partitionBy(*leaf).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialize(slices.withColumn("__before", F.coalesce(F.sum("__size").over(upto), F.lit(0))), "slices")
    placed = placed.join(slices, [*leaf, "__slice"])
    cut = (F.col("__before") < F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__size"))
    whole = placed.where(~cut).withColumn("__last", F.when(F.col("__before") < F.col("__rest"), F.col("__tokens")).otherwise(0))
    order = Window.partitionBy(*leaf, "__slice").orderBy("__at", "__tokens", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = placed.where(cut).withColumn("__done", F.col("__before") + F.coalesce(F.sum("__tokens").over(order), F.lit(0)))
    part = part.withColumn("__last", F.greatest(F.lit(0), F.least(F.col("__tokens"), F.col("__rest") - F.col("__done")))).drop("__done")
    both = whole.unionByName(part).where("__full > 0 OR __last > 0")
    new = [F.col(v).cast("string" if k == "domain" else "bigint") for k, v in NEW.items()]
    return both.select(*kept, *new).toDF(*given, *NEW)
