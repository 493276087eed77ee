"""Language-model scoring by cross-entropy difference of a target and a background bigram model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, small_side

VOCABULARY = 50_000  # most frequent words; all others are one unknown word
STRENGTH = 20.0  # pseudo-count of the unigram model in a bigram's estimate
SCALE = 1 << 20  # losses are summed as multiples of 1 / SCALE bits, so that their order does not matter
HOT = 1 << 14  # a pair that makes more than one in HOT words is looked up at once: there are fewer than HOT of them
HELD = 1 << 21  # counts or words held by a task before it sends or folds them
ODD = 2654435769  # multiplier that spreads pairs over 32 bits, one to one
BACK = pow(ODD, -1, 1 << 32)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _pack(*parts: np.ndarray) -> bytes:
    return pa.compress(b"".join(p.tobytes() for p in parts), codec="zstd", asbytes=True)


def _unpack(blob: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    """Arrays of ``size`` values each."""
    raw = pa.decompress(blob, decompressed_size=size * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, size, at))
        at += out[-1].nbytes
    return out


def _pieces(b: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
        yield b.slice(i, j - i)
        i = j


def vocabulary(docs: DataFrame, size: int) -> tuple[dict[str, int], np.ndarray]:
    """Ids of the ``size`` most frequent words of all documents (ties by word) and the counts of all ids in both models.

    Id 0 stands for all other words, the last one for the start of a text.  Row 0 of the counts is the background (all
    documents), row 1 the target (those with ``target``).  The words are counted over all documents; ``size`` of them
    come to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            words = list(seen[0])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(seen[0].values()), pa.int64()),
                                               pa.array([seen[1][w] for w in words], pa.int64())], ["word", "n", "m"])

        for b in batches:
            for t, target in zip(b.column("text"), b.column("target").to_pylist()):
                words = words_of(t.as_py())
                for s in seen[:2 if target else 1]:
                    s.update(words)
                    if words:
                        s[""] += 1  # no word is empty: the number of starts
                if len(seen[0]) > 200_000:
                    yield out()
                    seen[0].clear(), seen[1].clear()
        if seen[0]:
            yield out()

    counts = docs.select("text", "target").mapInArrow(run, "word string, n bigint, m bigint")
    counts = materialize(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "words")
    top = counts.where("word <> ''").orderBy(F.col("n").desc(), "word").limit(size).toArrow()
    starts, totals = (counts.where(c).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first() for c in ("word = ''", "word <> ''"))
    known = np.stack([top[c].to_numpy().astype(np.int64) for c in ("n", "m")])
    uni = np.concatenate([np.array([totals]).T - known.sum(1, keepdims=True), known, np.array([starts]).T], axis=1)
    return {w: k + 1 for k, w in enumerate(top["word"].to_pylist())}, uni


def _pairs(texts: pa.Array, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pair of every word and the one before it, spread over 32 bits, and the number of words of every text."""
    get = ids.get
    parts = [[get(w, 0) for w in words_of(t.as_py())] for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    word = np.fromiter((w for p in parts for w in p), np.uint32, int(n.sum()))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = len(ids) + 1
    return (before * np.uint32(len(ids) + 2) + word) * np.uint32(ODD), n


def pair_losses(key: np.ndarray, counts: np.ndarray, uni: np.ndarray) -> np.ndarray:
    """Losses of pairs with these ``counts`` (model, pair) under both models, in units of 1 / SCALE bits.

    A pair's probability is its share of all pairs with the same first word, smoothed by STRENGTH words of the unigram
    model, in which every word counts once more than it was seen.
    """
    width = uni.shape[1]
    before, word = np.divmod(key * np.uint32(BACK), np.uint32(width))
    total = uni[:, :-1].sum(1, keepdims=True)
    p = (uni[:, word] + 1.0) / (total + width - 1)
    return np.rint(-np.log2((counts + STRENGTH * p) / (uni[:, before] + STRENGTH)) * SCALE).astype(np.int64)


def _tally(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their summed counts (model, pair)."""
    key, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts], axis=1)
    if not len(key):
        return key, counts
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(counts[:, order], first, axis=1)


def _cuts(key: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a bucket; a bucket holds the pairs with the same upper bits."""
    g = (key >> np.uint32(shift)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return list(zip(g[at].tolist(), at.tolist(), [*at[1:].tolist(), len(g)]))


def count_pairs(docs: DataFrame, ids: dict[str, int], shift: int, hot: int) -> DataFrame:
    """(bucket, hot, size, counts): the exact counts of all pairs in both models, packed by bucket.

    A task adds up what it reads before sending it, so a frequent pair is one number a task.  Pairs seen more than ``hot``
    times have rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    kinds, names = "bucket int, hot boolean, size int, counts binary", ["bucket", "hot", "size", "counts"]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], names)

    def packed(key: np.ndarray, counts: np.ndarray, is_hot: bool) -> list[tuple]:
        return [(g, is_hot, j - i, _pack(counts[0, i:j], counts[1, i:j], np.diff(key[i:j], prepend=np.uint32(0)))) for g, i, j in _cuts(key, shift)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for b in _pieces(whole, "text"):
                key, n = _pairs(b.column("text"), shared.value)
                flag = np.repeat(b.column("target").to_numpy(zero_copy_only=False).astype(np.int64), n)
                held.append(_tally([(key, np.stack([np.ones_like(flag), flag]))]))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_tally(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(packed(*held[0], False))
                        held = []
        if held:
            yield rows(packed(*_tally(held), False))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out():
            key, counts = _tally(held)
            many = counts[0] > hot
            return rows(packed(key[~many], counts[:, ~many], False) + packed(key[many], counts[:, many], True))

        for b in batches:
            for g, k, blob in zip(b.column("bucket").to_pylist(), b.column("size").to_pylist(), b.column("counts")):
                if g != now and held:
                    yield out()
                    held, size = [], 0
                now = g
                n, m, step = _unpack(blob.as_py(), k, np.int64, np.int64, np.uint32)
                held.append((np.cumsum(step, dtype=np.uint32), np.stack([n, m])))
                size += k
                if size > HELD:
                    held = [_tally(held)]
                    size = 0  # what is left is bounded by the number of different pairs of a bucket
        if held:
            yield out()

    sent = docs.select("text", "target").mapInArrow(run, kinds)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, kinds)


def score(docs: DataFrame, targets: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document; low scores are like the target.

    Both models are bigram models over one vocabulary of ``size`` words (65 534 at most), smoothed towards their unigrams:
    the background counts all documents, the target those whose doc_id is in ``targets``.  All pairs of words are counted
    exactly and the counts are joined with the words of the documents by bucket.  Losses are bits per word over the whole
    text, and the score is target minus background.  Null and empty texts have 0 tokens and null losses; repeated rows
    are counted and scored each; with no target document the target model is uniform.
    """
    if size > 65_534:
        raise ValueError("a pair of words must fit into 32 bits")
    spark = docs.sparkSession
    chosen = materialize(targets.select("doc_id").where("doc_id IS NOT NULL").distinct(), "targets")
    marked = docs.select("doc_id", "text").join(small_side(chosen.withColumn("target", F.lit(True))), "doc_id", "left")
    marked = marked.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    ids, uni = vocabulary(marked, size)
    total = int(uni[0, :-1].sum())
    bits = min(12, max(8, (total >> 19).bit_length()))  # half a million different pairs a bucket are never much exceeded
    shift = 32 - bits
    salts = 1 + (total >> bits + 24)  # parts of a bucket's words, each joined with a copy of its counts

    counts = materialize(count_pairs(marked, ids, shift, total // HOT), "pairs")
    frequent = [_unpack(r["counts"], r["size"], np.int64, np.int64, np.uint32) for r in counts.where("hot").collect()]  # fewer than HOT pairs
    found = [(np.cumsum(step, dtype=np.uint32), np.stack([n, m])) for n, m, step in frequent]
    hot_key, hot_counts = _tally([(np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)), *found])
    shared = spark.sparkContext.broadcast((ids, uni, hot_key, pair_losses(hot_key, hot_counts, uni)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sums(doc: np.ndarray, loss: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.bincount(doc, weights=x, minlength=n).astype(np.int64) for x in loss]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, hot_key, hot_loss = shared.value
        chunk = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in _pieces(whole, "text"):
                key, n = _pairs(b.column("text"), ids)
                doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
                at = np.searchsorted(hot_key, key)
                hot = np.append(hot_key, np.uint32(0))[at] == key
                hot &= at < len(hot_key)
                out = [(chunk, -1, len(n), len(n), _pack(n, *sums(doc[hot], hot_loss[:, at[hot]], len(n))))]
                key, doc = key[~hot], doc[~hot]
                order = np.argsort((key >> np.uint32(shift)).astype(np.uint16), kind="stable")
                key, doc = key[order], doc[order]
                out += [(chunk, g, len(n), j - i, _pack(key[i:j], doc[i:j])) for g, i, j in _cuts(key, shift)]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
                names = pa.array([b.column("doc_id").to_pylist()] + [None] * (len(out) - 1), pa.list_(b.column("doc_id").type))
                yield pa.RecordBatch.from_arrays([*cols, names], ["chunk", "bucket", "docs", "size", "data", "ids"])
                chunk += 1

    # written, as which texts make a chunk could change if a task ran again
    sent = materialize(marked.select("doc_id", "text").mapInArrow(
        send, f"chunk bigint, bucket int, docs int, size int, data binary, ids array<{kind}>"), "words-by-bucket")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = shared.value[1]
        table, loss = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)
        for b in batches:
            out = []
            for chunk, docs, size, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "docs", "size", "data"))):
                if chunk is None:
                    n, m, step = _unpack(data, size, np.int64, np.int64, np.uint32)
                    table = np.cumsum(step, dtype=np.uint32)
                    loss = pair_losses(table, np.stack([n, m]), uni)
                else:
                    key, doc = _unpack(data, size, np.uint32, np.uint32)
                    out.append((chunk, docs, _pack(*sums(doc, loss[:, np.searchsorted(table, key)], docs))))
            cols = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], ["chunk", "docs", "data"])

    words = sent.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"), "chunk", "docs", "size", "data")
    tables = counts.where("NOT hot").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"),
                                            F.lit(None).cast("bigint").alias("chunk"), F.lit(0).alias("docs"), "size", F.col("counts").alias("data"))
    both = words.unionByName(tables).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("chunk").asc_nulls_first())
    part = both.mapInArrow(look_up, "chunk bigint, docs int, data binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, names, total = None, None, None, None

        def out():
            mean = total / np.maximum(n, 1) / SCALE
            cols = [pa.array(x, mask=n == 0) for x in (mean[1], mean[0], mean[1] - mean[0])]
            return pa.RecordBatch.from_arrays([names, pa.array(n), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        for b in batches:
            lists = b.column("ids")
            for k, (chunk, docs, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chunk", "docs", "data")))):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, np.zeros((2, docs), np.int64)
                if lists[k].is_valid:
                    n, *some = _unpack(data, docs, np.int64, np.int64, np.int64)
                    names = lists[k].values
                else:
                    some = _unpack(data, docs, np.int64, np.int64)
                total += np.stack(some)
        if now is not None:
            yield out()

    heads = sent.where("bucket < 0").select("chunk", "docs", "data", "ids")
    every = heads.unionByName(part, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk")
    return every.mapInArrow(gather, f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")
