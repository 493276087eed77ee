"""SimHash near-duplicates, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import components, groups, numbered

SEED = 42
BLOCKS = (13, 13, 13, 13, 12)  # widths of the parts of a fingerprint; at radius 3 two of five parts agree
CHUNK = 2048  # fingerprints of one bucket that are compared with as many others in one piece


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words (A-Z lower-cased); a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    return [h(b" ".join(z), SEED) for z in zip(*(words[k:] for k in range(width)))]


def vote(hashes: list[int]) -> int:
    """Fingerprint: the bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # a long text in pieces
        part = np.array(hashes[i:i + (1 << 14)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; texts without words, null or empty have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([vote(shingle_hashes(t.as_py(), width)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints as 64 planes: bit m of plane b is bit b of fingerprint m.  (blocks, 64) of uint64."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view("<u8")[:, :, 0]


def near_lanes(queries: np.ndarray, planes: np.ndarray, valid: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members within ``radius`` of each query in its block: (query index, lane).

    64 distances are counted at once by carry-save counters of log2(radius + 1) bits; a lane that overflows is out,
    and a query leaves once all lanes of its block are out.
    """
    depth = radius.bit_length()
    live = np.arange(len(queries))
    out = ~valid[block]
    count = np.zeros((depth, len(queries)), np.uint64)
    start = np.uint64(0) if radius == (1 << depth) - 1 else np.uint64((1 << depth) - 1 - radius)
    for k in range(depth):  # counters start so that radius + 1 steps overflow
        if int(start) >> k & 1:
            count[k] = ~np.uint64(0)
    for b in range(64):
        bit = (queries[live] >> np.uint64(b)) & np.uint64(1)
        carry = planes[block[live], b] ^ (np.uint64(0) - bit)
        for k in range(depth):
            carry, count[k] = carry & count[k], carry ^ count[k]
        out |= carry
        if b % 8 == 7:
            stay = out != ~np.uint64(0)
            if not stay.all():
                live, out, count = live[stay], out[stay], count[:, stay]
    lanes = np.unpackbits((~out).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    q, lane = np.nonzero(lanes)
    return live[q], lane


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A smaller set of links with the same components: every node with its component's first node."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[:len(a)], idx[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[x], label[y])
        np.minimum.at(low, label[y], label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the pieces (t, key, i, j): all of part i with part j; i = j compares one part with itself."""
    for t in groups(batches, ["t", "key", "i", "j"]):
        fp = t["fp"].to_numpy().view(np.uint64)
        second = t["second"].to_numpy(zero_copy_only=False).astype(bool)
        key = np.stack([t[c].to_numpy() for c in ("t", "key", "i", "j")])
        new = np.ones(len(fp), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        group = np.cumsum(new) - 1
        self_piece = key[2] == key[3]
        member, asks = np.flatnonzero(second | self_piece), np.flatnonzero(~second)
        # members are laid out in blocks of 64 that hold one piece only
        g = group[member]
        at = np.arange(len(member)) - np.searchsorted(g, g)
        n_blocks = -(-np.bincount(g, minlength=group[-1] + 1) // 64)
        first = np.concatenate([[0], np.cumsum(n_blocks)])
        slot = (first[g] + at // 64) * 64 + at % 64
        laid, filled, owner = np.zeros(first[-1] * 64, np.uint64), np.zeros(first[-1] * 64, bool), np.zeros(first[-1] * 64, np.int64)
        laid[slot], filled[slot], owner[slot] = fp[member], True, member
        valid = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        reps = n_blocks[group[asks]]
        ends = np.cumsum(reps)
        lo = 0
        while lo < len(asks):  # at most about 65 536 (query, block) comparisons at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 16), "right")))
            q = np.repeat(asks[lo:hi], reps[lo:hi])
            step = np.arange(len(q)) - np.repeat(np.cumsum(reps[lo:hi]) - reps[lo:hi], reps[lo:hi])
            block = first[group[q]] + step
            used, at_block = np.unique(block, return_inverse=True)
            planes = bit_planes(laid.reshape(-1, 64)[used].ravel())
            k, lane = near_lanes(fp[q], planes, valid[used], at_block, radius)
            other = owner[block[k] * 64 + lane]
            differ = fp[q[k]] != fp[other]
            a, b = fp[q[k][differ]], fp[other[differ]]
            if len(a):
                a, b = _forest(np.concatenate([left[-1], a]), np.concatenate([right[-1], b]))
                left, right = [a], [b]
            lo = hi
        if len(left[-1]):
            yield pa.RecordBatch.from_arrays([pa.array(left[-1].view(np.int64)), pa.array(right[-1].view(np.int64))], ["a", "b"])


def links(fps: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``radius`` bits into the same components.

    Fingerprints that agree in two of the five parts meet in a bucket (radius 3 changes at most three parts; other radii
    use radius + 2 parts).  A bucket of more than CHUNK members is cut in chunks, and each pair of chunks is a piece of its
    own, so that no task holds a whole bucket.  Of the links in a piece only a spanning forest leaves it.
    """
    widths = BLOCKS if radius == 3 else tuple(64 // (radius + 2) + (k < 64 % (radius + 2)) for k in range(radius + 2))
    starts = [sum(widths[:k]) for k in range(len(widths))]
    masks = []
    for pair in combinations(range(len(widths)), 2):
        m = sum(((1 << widths[k]) - 1) << starts[k] for k in pair)
        masks.append(m - (1 << 64) if m >> 63 else m)
    spread = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    full = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = spread.join(full, ["t", "key"]).withColumn("c", F.ceil(F.col("n") / CHUNK).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    pieces = member.select("t", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           (F.col("own") > F.col("other")).alias("second"))
    pieces = pieces.repartition("t", "key", "i", "j") if parts is None else pieces.repartition(parts, "t", "key", "i", "j")
    pieces = pieces.sortWithinPartitions("t", "key", "i", "j")
    return pieces.mapInArrow(lambda it: _compare(it, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, itself included.  Equal
    fingerprints are linked, also those of texts without words (0).  Repeated rows give repeated rows; a null doc_id
    keeps its row and never names a component unless nothing else is in it.  Other columns play no part.
    """
    fps = materialize(fingerprints(docs, width), "fp")
    owners = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-owners")
    roots = components(links(owners.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = owners.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(low, "root").select("fp", "component_id"), "fp-components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, with its columns.

    Documents that share that doc_id and component are repeated rows; one of them stays.  The same holds for
    components in which every doc_id is null.  Other columns may have any name.
    """
    names, docs = docs.columns, numbered(docs, "doc_id", "text")
    found = materialize(near_duplicates(docs, width, radius), "near")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(
        F.count("*").alias("__n"))
    keep = materialize(keep, "near-keep")
    kept = docs.join(keep.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "inner").drop("__id")
    if keep.where("__n > 1").isEmpty():
        return kept.drop("__n").toDF(*names)
    single = kept.where("__n = 1").drop("__n")
    again = kept.where("__n > 1").drop("__n")
    marked = fingerprints(again.withColumn("__row", F.struct(*docs.columns)), width, key="__row")
    comp = found.select("fp", F.col("component_id").alias("__c")).distinct()
    marked = marked.join(comp, "fp").where(F.col("__row.doc_id").eqNullSafe(F.col("__c")))
    return single.unionByName(marked.groupBy("__c").agg(F.min_by("__row", F.xxhash64("__row")).alias("r")).select("r.*")).toDF(*names)
