"""Query of the Merkle manifest, and its SQL with the levels written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import merkle
from .common import table
from .registry import query

SOURCE_LEVELS, TOP_LEVELS = 5, 2  # of the SQL: 16 ** 5 rows a source, 16 ** 2 sources

# The CRC-32 of the decimal doc_id, a byte at a time through a table of the 256 remainders.
CRC_SQL = """crc_step AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) x(i)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text; needs ``crc_step`` in scope as the one-row table ``crc_step``."""
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), "
            "lambda c, b: xor(c >> 8, crc_step.t[1 + (xor(c, b) & 255)])), 4294967295)")


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """CTEs name0 .. namedepth (tree, r, h, size) and runs name_k (tree, r, hs) of each level."""
    out = [f"{name}0 AS (SELECT tree, r, h, size FROM {leaves})"]
    for k in range(depth):
        out.append(f"{name}_{k} AS (SELECT tree, r // 16 AS r, list(h ORDER BY r) AS hs, any_value(size) AS size FROM {name}{k}"
                   f" WHERE size > {16 ** k} GROUP BY tree, r // 16)")
        out.append(f"{name}{k + 1} AS (SELECT tree, r, sha256(array_to_string(hs, '')) AS h, size FROM {name}_{k})")
    out.append(f"{name}_top AS (" + " UNION ALL ".join(
        f"SELECT tree, h FROM {name}{k} WHERE size <= {16 ** k}" + (f" AND size > {16 ** (k - 1)}" if k else "") for k in range(depth + 1)) + ")")
    return ",\n".join(out)


def _climb(name: str, depth: int, start: str, tree: str, rank: str) -> str:
    """CTEs that add the siblings of each level to ``proof`` and fold them into ``cur``."""
    out, last = [], start
    for k in range(depth):
        place = f"(d.{rank} // {16 ** k}) % 16 + 1"
        out.append(f"{name}c{k} AS (SELECT d.* REPLACE ("
                   f"CASE WHEN g.hs IS NULL THEN proof ELSE proof || array_to_string(list_concat(g.hs[1:{place} - 1], g.hs[{place} + 1:]), '') END AS proof, "
                   f"CASE WHEN g.hs IS NULL THEN d.cur ELSE sha256(array_to_string(g.hs[1:{place} - 1], '') || d.cur || array_to_string(g.hs[{place} + 1:], '')) END AS cur) "
                   f"FROM {last} d LEFT JOIN {name}_{k} g ON g.tree = d.{tree} AND g.r = d.{rank} // {16 ** (k + 1)})")
        last = f"{name}c{k}"
    return ",\n".join(out)


MANIFEST_SQL = f"""WITH {CRC_SQL},
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
    sha256({" || ".join(_field(c) for c in merkle.FIELDS)}) AS leaf,
    sha256({" || ".join(_field(c) for c in merkle.FIELDS[:-1])} || {_field(f"translate(text, '{merkle.LETTERS}', '{merkle.LETTERS.lower()}')")}) AS other,
    {crc_sql("doc_id::VARCHAR")} % 5 = 0 AS hit FROM documents, crc_step),
leaves AS (SELECT doc_id, tree, leaf, leaf AS h, CASE WHEN hit THEN other ELSE leaf END AS cur, '' AS proof, count(*) OVER (PARTITION BY tree) AS size,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
{_tree_sql("a", "leaves", SOURCE_LEVELS)},
tops AS (SELECT '' AS tree, tree AS name, h, count(*) OVER () AS size, row_number() OVER (ORDER BY tree) - 1 AS r FROM a_top),
{_tree_sql("b", "tops", TOP_LEVELS)},
placed AS (SELECT leaves.*, tops.r AS tr, tops.tree AS ttree, tops.h AS subroot FROM leaves JOIN tops ON tops.name = leaves.tree),
{_climb("a", SOURCE_LEVELS, "placed", "tree", "r")},
{_climb("b", TOP_LEVELS, f"ac{SOURCE_LEVELS - 1}", "ttree", "tr")}
SELECT doc_id, leaf, subroot, b_top.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b_top.h AS verified
FROM bc{TOP_LEVELS - 1}, b_top"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark, sf_dir):
    found = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), *merkle.tampering()))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
