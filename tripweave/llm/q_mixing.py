"""Query of the mixing operator, with SQL of its own for the same budgets and prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing
from .common import table
from .registry import query


def domain():
    """The documents name no domain; sources are put in four groups by their number."""
    return F.concat(F.lit("group"), (F.coalesce(F.nullif(F.regexp_extract("source", "[0-9]+", 0), F.lit("")).cast("int"), F.lit(0)) % 4).cast("string"))


WEIGHTS = {
    "domain": {"group0": 4, "group1": 3, "group2": 2, "group3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 3},
}
SHARE, EPOCHS, SEED = 1.0, 2, 7


def _level(k: int) -> str:
    levels = ["domain", "lang", "source"]
    keys, name = levels[:k], levels[k]
    w = "CASE " + name + " " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in WEIGHTS[name].items()) + " ELSE 1 END"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    cols = ", ".join([*keys, name])
    given = "(SELECT total FROM grand)" if k == 0 else "g.given"
    join = "" if k == 0 else f"JOIN given{k - 1} g USING ({', '.join(keys)})"
    return f"""
n{k} AS (SELECT {cols}, cap, supply, {w} AS w, {given} AS given
  FROM (SELECT {cols}, sum(cap)::BIGINT AS cap, sum(supply)::BIGINT AS supply FROM leaf GROUP BY {cols}) {join}),
f{k} AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS before, sum(w) OVER p - coalesce(sum(w) OVER o, 0) AS rest_w FROM n{k}
  WINDOW p AS ({part}), o AS ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{k} AS (SELECT *, cap <= w * ((given - before) / rest_w) AS closed FROM f{k}),
l{k} AS (SELECT *, given - sum(CASE WHEN closed THEN cap ELSE 0 END) OVER p AS rest,
  sum(CASE WHEN closed THEN 0 ELSE w END) OVER p AS open_w FROM s{k} WINDOW p AS ({part})),
e{k} AS (SELECT *, CASE WHEN closed THEN cap::DOUBLE ELSE w * (rest / open_w) END AS exact FROM l{k}),
w{k} AS (SELECT *, least(floor(exact)::BIGINT, cap) AS whole FROM e{k}),
r{k} AS (SELECT *, least(given, sum(cap) OVER p) - sum(whole) OVER p AS spare,
  row_number() OVER ({part} ORDER BY closed, whole - exact, {name}) AS place FROM w{k} WINDOW p AS ({part})),
given{k} AS (SELECT {cols}{", supply" if k == 2 else ""}, whole + CASE WHEN place <= spare AND NOT closed THEN 1 ELSE 0 END AS given FROM r{k})"""


SQL = f"""
WITH d AS (SELECT doc_id, 'group' || (coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS INT), 0) % 4) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
grand AS (SELECT floor(sum(supply) * {SHARE})::BIGINT AS total FROM leaf),
{_level(0)}, {_level(1)}, {_level(2)},
q AS (SELECT d.*, given // supply AS full_epochs, given % supply AS rest FROM d JOIN given2 USING (domain, lang, source) WHERE n_tokens > 0),
t AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}|' || (full_epochs + 1)::BIGINT || '|' || doc_id), n_tokens, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM q)
SELECT doc_id, lang, source, domain, n_tokens, full_epochs::BIGINT AS full_epochs,
  greatest(0, least(n_tokens, rest - done))::BIGINT AS last_tokens
FROM t WHERE full_epochs > 0 OR greatest(0, least(n_tokens, rest - done)) > 0"""


@query("op1_mixing", SQL)
def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix(docs, domain(), WEIGHTS, SHARE, EPOCHS, SEED, keep=["doc_id", "lang", "source"])
