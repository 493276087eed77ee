"""Recall of the seeds against Smith-Waterman alignment of every document with every item."""

import numpy as np
import pyarrow as pa

from tripweave.llm import decontaminate as dc

RNG = np.random.default_rng(17)


def sentence(n):
    return ["w%d" % min(x, 3000) for x in RNG.zipf(1.3, n)]


def edited(words, share):
    """Each word is kept, or replaced, dropped or followed by another one, ``share`` of them."""
    out = []
    for w in words:
        u = RNG.random()
        if u >= share:
            out.append(w)
        elif u < share / 3:
            out.append("x%d" % RNG.integers(9))
        elif u < share * 2 / 3:
            out += [w, "x%d" % RNG.integers(9)]
    return out


def hashes(text):
    return dc.word_hashes(*dc.as_bytes(pa.array([text])))[0]


def test_edited_copies_are_found(spark):
    items = [(k, " ".join(sentence(int(n)))) for k, n in enumerate(RNG.integers(10, 60, 60))]
    texts = []
    for _, item in items:
        for share in (0.0, 0.05, 0.1, 0.15, 0.2):
            texts.append(" ".join(sentence(60) + edited(item.split(), share) + sentence(60)))
    docs = [(d, t) for d, t in enumerate(texts + [" ".join(sentence(200)) for _ in range(100)])]
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                                        spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = set()
    for k, item in items:
        q = hashes(item)
        for d, t in docs:
            if dc.align(q, hashes(t))[0] >= 0.6 * dc.MATCH * min(len(q), dc.FULL):
                want.add((d, k))
    assert got <= want and len(want) > 200
    print("recall", len(got) / len(want), len(want))
    assert len(got) >= 0.95 * len(want)


def test_short_and_edited_items(spark):
    item = "the quick brown fox jumps over the lazy dog near a river".split()
    cut = item[:3] + ["x"] + item[4:7] + ["y"] + item[8:10] + ["z"] + item[11:]
    items = spark.createDataFrame([(1, "what is entropy"), (2, " ".join(item)), (3, "two words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "they ask: What is entropy? and more"), (2, "p q " + " ".join(cut) + " r s"), (3, "what was entropy in two words")],
                                 "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 2) for r in dc.find_leaks(docs, items).collect()}
    assert got == {(1, 1): 1.0, (2, 2): round((9 * 2 - 3) / 24, 2)}
