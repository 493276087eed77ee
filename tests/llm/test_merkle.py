"""The Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tripweave.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, `row.x` string, digest int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root and, for each leaf, its (left, right) siblings level by level."""
    paths, level = [[] for _ in leaves], [(h, [k]) for k, h in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), 16):
            run = [h for h, _ in level[a:a + 16]]
            for j, (_, members) in enumerate(level[a:a + 16]):
                for k in members:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append((sha(*run), [k for _, members in level[a:a + 16] for k in members]))
        level = above
    return level[0][0], paths


def expected(rows):
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        h = other = leaf(doc_id, source, lang, n_chars, text)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            other = leaf(doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, h, doc_id, other))
    tops = []
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(sources[s], key=lambda x: x[:3])
        tops.append((members, *tree([x[2] for x in members])))
    root, upper = tree([t[1] for t in tops])
    out = []
    for (members, sub, paths), up in zip(tops, upper):
        for (_, _, h, doc_id, other), path in zip(members, paths):
            at = other
            for left, right in path + up:
                at = sha(left, at, right)
            out.append((doc_id, h, sub, root, sha(*[x + y for x, y in path + up]), at, at == root))
    return out


@pytest.mark.parametrize("n, sources", [(0, 1), (1, 1), (2, 2), (17, 1), (300, 40), (700, 2)])
def test_manifest_equals_plain_tree(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", "é", *[f"s{k}" for k in range(sources)]] if sources > 1 else ["s"]
    rows = [(rng.choice([None, k, k // 2]), rng.choice([None, "", "Ab É", "x", "LONG " * 9000 if k == 5 else "Q"]), rng.choice([None, "en"]),
             rng.choice(names), rng.choice([None, 3])) for k in range(n)]
    rows += rows[:3]
    docs = spark.createDataFrame([(*r, "t", "u", 1) for r in rows], DOCS)
    found = merkle.verify(merkle.manifest(docs, *merkle.tampering()))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows) if rows else []))


def test_untouched_rows_verify(spark):
    docs = spark.createDataFrame([(k, "Text", "en", "a", 4, "t", "u", 1) for k in range(40)], DOCS)
    assert [r.verified for r in merkle.verify(merkle.manifest(docs)).select("verified").collect()] == [True] * 40
