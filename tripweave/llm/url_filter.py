"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs in front of an exact join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

LANES = 8  # 64-bit words of a block; a URL sets one bit in each
URLS_PER_BLOCK = 32  # 16 bits a URL
BROADCAST_BLOCKS = 1 << 17  # filters up to this size (9 MB) are broadcast, larger ones are joined by block
AUTHORITY = r"://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty if there is none."""
    found = F.coalesce(F.regexp_extract(F.col(url), AUTHORITY, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: str = "url") -> Column:
    """Path up to the query or fragment; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.col(url), AUTHORITY, 2), F.lit(""))


def canonical(url: str = "url") -> Column:
    """One form of URLs that name the same page: no scheme, leading ``www.``, trailing slash, fragment or tracking
    parameters (utm_*, ref); other parameters sorted.  A null URL is the empty one."""
    query = F.coalesce(F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null; a rule ``host/path`` fits the host and its subdomains
    if the path starts with the rule's.  Needs the columns host and path."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    listed = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(r.partition("/")[0]).alias("h"),
                                F.lit("/" + r.partition("/")[2]).alias("p")) for v, r in ranked))
    fits = F.filter(listed, lambda r: F.startswith(F.col("path"), r["p"]) &
                    ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))))
    return F.get(fits, 0)


def _bit(key: Column, lane: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(F.xxhash64(F.lit(lane), key), 58).cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The filter as a table: block, w0 ... w7; a block is OR-ed together by partial aggregation."""
    h = F.xxhash64(key)
    return listed.groupBy(F.pmod(h, F.lit(blocks)).alias("block")).agg(*(F.bit_or(_bit(h, k)).alias(f"w{k}") for k in range(LANES)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., host, path, rule, verdict, listed) of every row.

    A fitting rule decides; else a page is blocked if its canonical URL is that of a row of ``listed`` (column ``url``).
    The filter has no false negatives; the URLs that it passes are joined exactly, the others are allowed at once.  A null or
    strange URL has empty host and path, fits no rule, and is never listed.  Repeated rows are judged each.
    """
    names = materialize(listed.select(canonical("url").alias("key")).where("key <> ''").distinct(), "listed")
    blocks = 1
    while blocks * URLS_PER_BLOCK < names.count():
        blocks *= 2
    bloom = materialize(bloom_blocks(names, blocks), "bloom")
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    rows = pages.select(*keep, host(url).alias("host"), path(url).alias("path"), canonical(url).alias("__key"))
    rows = rows.withColumn("__rule", rule_of(rules))
    h = F.xxhash64("__key")
    rows = rows.join(bloom, F.pmod(h, F.lit(blocks)) == F.col("block"), "left")
    passed = F.lit(True)
    for k in range(LANES):
        passed = passed & (F.col(f"w{k}").bitwiseAND(_bit(h, k)) != 0)
    rows = rows.select(*keep, "host", "path", "__rule", "__key", F.coalesce(passed, F.lit(False)).alias("__maybe"))
    rows = materialize(rows, "judged")
    sure = rows.where(~F.col("__maybe")).withColumn("listed", F.lit(False))
    maybe = rows.where("__maybe").join(names.withColumn("listed", F.lit(True)), F.col("__key") == F.col("key"), "left").drop("key")
    both = sure.unionByName(maybe.withColumn("listed", F.coalesce("listed", F.lit(False))))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
