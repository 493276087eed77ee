"""Merkle manifest of a table: row digests, trees of runs of FAN nodes, inclusion proofs and their check.

Every node carries the interval [lo, hi) of the leaf ranks it covers.  A level is built by grouping the level below
by the bucket ``lo div FAN ** level``, so a group holds FAN rows at most, whatever the size of a source.  Ancestors are
attached from the top down: nodes of one level meet the nodes of the next one in the same bucket whose interval
contains theirs.  What the parent's interval has left of a node's own one and right of it are the siblings of a proof.
All of it is DataFrame code; nothing but the root and the size of the largest tree comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.common import q
from ..session import materialize, one_row

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as `-` (null) or its length in bytes, a colon and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(replaced: dict[str, Column] | None = None) -> Column:
    """Digest of a document row; ``replaced`` gives other values for some of its fields."""
    return digest(*[field((replaced or {}).get(c, q(c))) for c in FIELDS])


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and its siblings."""
    return F.aggregate(path, start, lambda at, s: digest(s["left"], at, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(tree, size, lo, hi, digest, row): the place of each row in its tree, by ``order``; and the size of the largest tree.

    ``rows`` is a written table.  Its rows are dealt by range, so a tree with most rows is spread over many tasks;
    a place is the place within the partition plus the rows of the tree in the partitions before it.
    """
    keys = ["tree", *order]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .select("tree", "digest", "row", F.monotonically_increasing_id().alias("at"))
                         .withColumn("part", F.shiftright("at", 33)), "merkle")
    starts = placed.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(starts.select("part", "tree", F.sum("n").over(tree).alias("size"),
                                       (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "merkle")
    ranked = (placed.join(starts, ["part", "tree"]).withColumn("lo", F.col("at") + F.col("shift"))
              .select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest", "row"))
    return ranked, one_row(starts.agg(F.max("size").alias("n")))["n"] or 0


def _levels(ranked: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels from the runs of leaves up, and the one top node of each tree: (tree, digest)."""
    levels, width, below = [], 1, ranked
    while width < largest:
        kid = F.struct("lo", "hi", "digest", *(["row"] if not levels else []))
        run = (below.where(F.col("size") > width).groupBy("tree", F.expr(f"lo div {width * FAN}").alias("bucket"))
               .agg(F.max("size").alias("size"), F.sort_array(F.collect_list(kid)).alias("kids")))
        width *= FAN
        below = materialize(run.select("tree", "size", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
                                       F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"), "kids"), "merkle")
        levels.append(below)
    tops = ranked.where("size = 1").select("tree", "digest")
    for k, level in enumerate(levels):
        tops = tops.unionAll(level.where(F.col("size") <= FAN ** (k + 1)).select("tree", "digest"))
    return levels, tops


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What a parent covers besides [lo, hi), as the joined digests on both sides."""
    side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k["digest"]), "")
    return F.struct(side(lambda k: k["hi"] <= lo).alias("left"), side(lambda k: k["lo"] >= hi).alias("right"))


def _paths(ranked: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, digest, row, top, path) of every leaf; ``above`` is (tree, top, path) of the trees' top nodes.

    A node joins its parent on tree and bucket and by containment of the intervals: FAN rows per key at most.
    """
    over = None
    for k in range(len(levels), 0, -1):
        level, width = levels[k - 1], FAN ** k
        found = level.where(F.col("size") <= width).join(above, "tree").select(level["*"], "top", "path")
        if over is not None:
            up = over.select(F.col("tree").alias("_tree"), F.expr(f"lo div {width * FAN}").alias("_bucket"), F.col("lo").alias("_lo"),
                             F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), "top", F.col("path").alias("_path"))
            inner = level.where(F.col("size") > width).withColumn("bucket", F.expr(f"lo div {width * FAN}"))
            inner = inner.join(up, (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket"))
                               & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
            found = found.unionByName(inner.select(
                level["*"], "top", F.concat(F.array(_siblings(F.col("_kids"), F.col("lo"), F.col("hi"))), F.col("_path")).alias("path")))
        over = materialize(found, "merkle") if k > 1 else found
    lone = ranked.where("size = 1").join(above, "tree").select("tree", "digest", "row", "top", "path")
    if over is None:
        return lone
    each = over.select("tree", "top", "kids", "path", F.explode("kids").alias("k"))
    return lone.unionByName(each.select(
        "tree", F.col("k.digest").alias("digest"), F.col("k.row").alias("row"), "top",
        F.concat(F.array(_siblings(F.col("kids"), F.col("k.lo"), F.col("k.hi"))), F.col("path")).alias("path")))


def manifest(docs: DataFrame, changed: Column | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, other, subroot, root, path) of every document row.

    Leaves of a source ascend by doc_id (null first, ties by leaf digest); the sources' top nodes, by source (null first,
    bytewise), are the leaves of one more tree with the root.  ``path`` holds the digests on both sides of the leaf and of
    each of its ancestors.  ``other`` is the digest of the row with the text ``changed`` where ``when`` holds, else the leaf.
    A null value and an empty one give different leaves; repeated rows are leaves of their own; an empty table has no
    rows; columns besides the five of a document are not read.
    """
    rows = docs.select(*[q(c) for c in FIELDS]).select(
        "doc_id", "source", row_digest().alias("leaf"),
        (F.when(when, row_digest({"text": changed})) if changed is not None else F.lit(None).cast("string")).alias("other"))
    rows = rows.select(F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("tree"),
                       F.col("leaf").alias("digest"), F.struct("doc_id", "source", F.coalesce("other", "leaf").alias("other")).alias("row"),
                       "doc_id", F.monotonically_increasing_id().alias("copy"))
    ranked, largest = _ranked(materialize(rows, "merkle"), ["doc_id", "digest", "copy"])
    levels, tops = _levels(ranked, largest)
    names = tops.select(F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("name")).alias("row"), F.col("tree").alias("name"))
    upper, sources = _ranked(names, ["name"])
    upper_levels, root = _levels(upper, sources)
    root = (root.first() or {"digest": None})["digest"]
    start = upper.where("lo = 0").select("tree", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    above = _paths(upper, upper_levels, start).select(F.col("row.name").alias("tree"), F.col("digest").alias("top"), "path")
    out = _paths(ranked, levels, materialize(above, "merkle"))
    return out.select("row.doc_id", "row.source", F.col("digest").alias("leaf"), "row.other", F.col("top").alias("subroot"),
                      F.lit(root).cast("string").alias("root"), "path")


def verify(proofs: DataFrame) -> DataFrame:
    """The manifest with the root recomputed from ``other`` and the original siblings, and whether it is the root."""
    return proofs.withColumn("folded_root", fold(F.col("other"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering() -> tuple[Column, Column]:
    """The text with A-Z in lower case, and for which documents: where 5 divides the CRC-32 of the id."""
    return F.translate("text", LETTERS, LETTERS.lower()), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
