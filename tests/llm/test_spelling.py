"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tripweave.llm import spelling

DOCS = "doc_id bigint, text string, word string, n bigint, `a.b` string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    found = {w: [o for o in words if near(w, o)] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) if o else None for w, o in found.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(found[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "ÀÉÿÀÉÿ", "a" * 40]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "é" + w[k + 1:]]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=150)) for _ in range(150)]
    chain = " ".join(["abcdefgh"] * 150 + ["abcdefgx"] * 30 + ["abcdefyx"] * 6)
    return [*enumerate(texts), (None, "Motörhead WORDS2words÷" * 9), (7, texts[7]), (900, ""), (901, None), (902, "x" * 100_000), (903, chain)]


def test_variants_equal_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "w", 1, "x") for d, t in rows], DOCS)
    monkeypatch.setattr(spelling, "PIECE", 100)
    want = expected(rows)
    assert len(want) > 100 and any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "w", 1, "x")], DOCS)).count() == 0


@pytest.mark.parametrize("prefix, want", [([(0, 5), (1, 1), (2, 4)], [0, 2]), ([(0, 9), (3, 1), (4, 2)], [0, 3]), ([(0, 2), (3, 1), (6, 0)], [3, 6])])
def test_pivots(prefix, want):
    """Disjoint, of the least sum of ranks."""
    got = spelling.pivots_of(prefix)
    ranks = dict(prefix)
    pairs = [(ranks[a] + ranks[b], [a, b]) for a in ranks for b in ranks if b - a >= 2]
    assert got[1] - got[0] >= 2 and ranks[got[0]] + ranks[got[1]] == min(pairs)[0]
    assert got == want
