"""SentencePiece encoding, spans and decoding against the library itself."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tripweave.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
DATA = open(MODEL, "rb").read()
ALPHABET = list("aeiou tnslr  .,\n\téàñß▁￾字漢🧿ﬁ①ｈ 　́​﻿\r\0½ª") + ["the ", " <s>", "<0x41>", "▁▁", "    ", "ing", "ﬁ", "가", "ｶﾞ", "¨"]


def texts(n=400, seed=2):
    rng = random.Random(seed)
    out = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(n)]
    return out + ["", " ", "  ", "▁", "a" * 5000, "字" * 300, "🧿" * 9, " lead and trail ", "x" * 101 + " " + "y" * 99]


def changed(**spec):
    """The model with other normaliser settings: charmap, prefix, trim."""
    out = b""
    if "charmap" in spec:
        n, size = len(spec["charmap"]), b""
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        out += bytes([18]) + size + bytes([n]) + spec["charmap"]
    for key, name in ((24, "prefix"), (32, "trim")):
        if name in spec:
            out += bytes([key, spec[name]])
    n, size = len(out), b""
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return DATA + bytes([26]) + size + bytes([n]) + out


def charmap():
    spec = next(v for k, v in pieces.wire(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if k == 3)
    return dict(pieces.wire(spec))[2]


@pytest.mark.parametrize("how", ["as it is", "trimmed", "mapped", "mapped and trimmed", "no prefix"])
def test_pieces_and_spans_equal_the_library(how):
    spec = {"trim": 1} if "trimmed" in how else {"prefix": 0} if how == "no prefix" else {}
    data = changed(**spec, **({"charmap": charmap()} if "mapped" in how else {})) if how != "as it is" else DATA
    model, library = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    some = texts()
    for text, (ids, begins, ends) in zip(some, model.encode(some)):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], text
        assert model.decode(ids) == library.decode(ids.tolist()), text


def test_decoding_of_any_ids():
    model, library, rng = pieces.load(DATA), sentencepiece.SentencePieceProcessor(model_proto=DATA), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 259, 0, 1]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(DATA + bytes([18, 2, 24, 1]))


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    monkeypatch.setattr(pieces, "STRETCH", 300)
    rows = [*enumerate(texts(60)), (None, "no id"), (3, None), (3, None)]
    docs = spark.createDataFrame([(d, t, [1], "x") for d, t in rows], "doc_id bigint, text string, ids array<int>, `n.b` string")
    found = pieces.encode(docs, DATA)
    library = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    want = sorted((str(d), library.encode(t or "")) for d, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in found.collect()) == want
    assert sorted((str(r.doc_id), r.decoded) for r in pieces.decode(found, DATA).collect()) == sorted((str(d), library.decode(library.encode(t or ""))) for d, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in pieces.encode(docs, DATA, decoded=True).collect()) == [(d, i, library.decode(i)) for d, i in want]
    assert pieces.decode(pieces.encode(docs.limit(0), DATA), DATA).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(map(tuple, entry.queries()["op12_sentencepiece"](spark, sf).collect())) == sorted(want)
