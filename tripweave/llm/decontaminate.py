"""Benchmark decontamination: rare n-gram seeds, then local alignment of passages with test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import MULT, PrefixHash, as_bytes, bloom_of, chunks, may_hold, mix, numbered, word_bounds

N = 3  # words of a seed; an item of 9 words or more with a score of 0.6 by replaced words alone has such a run left
STRETCH = 4  # of so many neighbouring seeds of an item the rarest is always used
RARE = 256  # seeds in so few passages are all used
MARGIN = 48  # words around the outermost seeds that are aligned too
FULL = 40  # words of a long item that make a full score
MATCH, MISMATCH, GAP = 2, -1, -1
BITS_PER_SEED = 64  # of the Bloom filter of seeds


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, lower-cased in ASCII and Latin-1) and their row numbers."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][wide] += 32
    is_word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    s, e, row = word_bounds(is_word, off)
    return PrefixHash(low).of(s, e), row


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of the N words from each place on."""
    n = max(len(words) - N + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(N):
        h = h * MULT + words[k:k + n]
    return mix(h)


def _item_rows(items: DataFrame) -> DataFrame:
    """(key, words, seed places and hashes) of every different item text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = as_bytes(b.column(1))
            w, row = word_hashes(data, off)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            parts = [w[x:y] for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64())),
                                              pa.array([grams(p).view(np.int64) for p in parts], pa.list_(pa.int64()))], ["item_id", "words", "grams"])

    rows = items.select("item_id", "text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, words array<bigint>, grams array<bigint>")
    return rows.where(F.array_size("grams") > 0).withColumn("key", F.xxhash64("words"))


def _passages(docs: DataFrame, filter_words: np.ndarray) -> DataFrame:
    """Stretches of word hashes around places whose N words may be a seed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(filter_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for b in batches:
            data, off = as_bytes(b.column(1))
            for i, j in chunks(off):
                w, row = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                g = grams(w)
                ok = row[:len(g)] == row[N - 1:] if len(g) else np.zeros(0, bool)
                at = np.flatnonzero(ok & may_hold(bloom, g))
                if not len(at):
                    continue
                cut = np.flatnonzero(np.r_[True, (row[at[1:]] != row[at[:-1]]) | (np.diff(at) > 2 * MARGIN)])
                ends = np.r_[cut[1:], len(at)]
                r = row[at[cut]]
                lo = np.maximum(at[cut] - MARGIN, np.searchsorted(row, r))
                hi = np.minimum(at[ends - 1] + N + MARGIN, np.searchsorted(row, r, "right"))
                base = np.searchsorted(row, r)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r + i)), pa.array(lo - base),
                     pa.array([w[x:y].view(np.int64) for x, y in zip(lo, hi)], pa.list_(pa.int64())),
                     pa.array([g[at[x:y]].view(np.int64) for x, y in zip(cut, ends)], pa.list_(pa.int64()))],
                    ["doc_id", "first", "words", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first bigint, words array<bigint>, hits array<bigint>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of the best local alignment and the passage position behind its end."""
    steps = -GAP * np.arange(len(passage) + 1)
    h = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        t = np.zeros_like(h)
        np.maximum(h[:-1] + np.where(passage == w, MATCH, MISMATCH), h[1:] + GAP, out=t[1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + steps) - steps
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


def _score(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        doc, key = b.column("doc_id"), b.column("key").to_pylist()
        for k, (first, passage, item) in enumerate(zip(b.column("first").to_pylist(), b.column("words"), b.column("item"))):
            p, q = passage.values.to_numpy(), item.values.to_numpy()
            best, end = align(q, p)
            score = min(1.0, best / (MATCH * min(len(q), FULL)))
            if score >= threshold:
                _, back = align(q[::-1], p[:end][::-1])
                out.append((k, key[k], score, first + end - back, first + end))
        if out:
            k, *cols = (list(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(k)), *(pa.array(c) for c in cols)], ["doc_id", "key", "score", "start", "end"])


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): test items that a document holds, also with edits.

    Words are letters and digits, lower-cased.  Seeds are runs of N words of an item that occur in documents: of each
    STRETCH neighbouring ones the rarest over all documents, and all that are rare.  A passage with a seed is aligned with
    the item (2 a match, -1 a mismatch or gap); the score is the share of what a full copy gets, for items of more than
    FULL words of what FULL words get.  The best place is given for each pair.  Null, empty or shorter texts and items of
    under N words have no seed and give no rows.  Repeated rows count once; equal items are each reported.
    """
    spark = docs.sparkSession
    listed = materialize(_item_rows(items), "items")
    seeds = listed.select("key", "grams").distinct().select("key", F.posexplode("grams").alias("pos", "gram"))
    passages = materialize(_passages(docs, bloom_of(seeds, "gram", BITS_PER_SEED)).withColumn("pid", F.xxhash64("doc_id", "first", "words")), "passages")
    hits = passages.select("pid", F.explode(F.array_distinct("hits")).alias("gram"))
    real = materialize(hits.join(seeds.select("gram").distinct(), "gram"), "seed-hits")
    df = real.groupBy("gram").agg(F.count("*").alias("df"))
    near = Window.partitionBy("key", F.floor(F.col("pos") / STRETCH)).orderBy("df", "pos")
    used = seeds.join(df, "gram").withColumn("k", F.row_number().over(near)).where((F.col("k") == 1) | (F.col("df") <= RARE))
    used = materialize(used.select("gram", "key").distinct(), "seeds")
    pairs = real.join(used, "gram").select("pid", "key").distinct()
    texts = listed.select("key", F.col("words").alias("item")).dropDuplicates(["key"])
    todo = pairs.join(passages.select("pid", "doc_id", "first", "words").dropDuplicates(["pid"]), "pid").join(texts, "key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = todo.select("doc_id", "key", "first", "words", "item").mapInArrow(
        lambda it: _score(it, threshold), f"doc_id {kind}, key bigint, score double, start bigint, end bigint")
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b")
    found = found.groupBy("doc_id", "key").agg(best)
    return found.join(listed.select("key", "item_id").distinct(), "key").select(
        "doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"), F.col("b.end").alias("end_word"))


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The documents without a test item, with their columns, whatever their names.

    A document is judged by its own text alone, as rows of equal text share their leaks: ids may be null or repeated.
    """
    rows = numbered(docs, "doc_id", "text")
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)
    texts = rows.select(digest.alias("doc_id"), "text")
    bad = materialize(find_leaks(texts, items, threshold).select(F.col("doc_id").alias("__bad")).distinct(), "leaking")
    return rows.join(bad, digest == F.col("__bad"), "left_anti").toDF(*docs.columns)
