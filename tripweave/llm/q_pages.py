"""Queries on the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import url_filter, warc
from .common import table
from .registry import query

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
INSULTS = "idiot|moron|scum|stupid|worthless"  # a page with such a word is listed

URL_SQL = f"""
WITH p AS (SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
    list_sort([x FOR x IN string_split(coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), ''), '&')
      IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')]) AS params FROM pages),
k AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE key <> '' AND regexp_matches(html, '\\b({INSULTS})\\b')),
r(verdict, rule, h, q) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
m AS (SELECT k.*, (SELECT max_by(struct_pack(verdict := r.verdict, rule := r.rule), length(r.rule)) FROM r
    WHERE (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.q)) AS best FROM k)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.key IS NOT NULL AS listed
FROM m LEFT JOIN l ON m.key = l.key"""


@query("op3_warc")
def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(rf"\b({INSULTS})\b")).select("url")
    return url_filter.judge(pages, listed, RULES)
