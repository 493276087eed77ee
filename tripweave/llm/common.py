"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns other than ``used`` named by their position, so that no name can clash or need quotes.

    ``toDF(*docs.columns)`` on the columns in their old order gives the names back.
    """
    return docs.toDF(*(c if c in used else f"column_{i}" for i, c in enumerate(docs.columns)))


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets; a null counts as an empty text."""
    col = pc.fill_null(col, "").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and their inverses."""
    inv = np.uint64(pow(int(MULT), -1, 1 << 64))
    p, q = np.full(n, MULT), np.full(n, inv)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHash:
    """Hashes of any substrings of one byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] ^ (np.asarray(end) - start).astype(np.uint64) * MULT)


def word_bounds(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of ``is_word``; a run ends at its row's end."""
    n = len(is_word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | first[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from a partition sorted by ``keys``; each holds one or more groups."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        differs = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            differs[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        if rest and any(b.column(k)[0] != rest[-1].column(k)[-1] for k in keys):
            differs[0] = True
        cut = np.flatnonzero(differs)
        if len(cut):
            last = int(cut[-1])
            whole = rest + ([b.slice(0, last)] if last else [])
            if whole:
                yield pa.Table.from_batches(whole)
            rest = [b.slice(last)]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node of an undirected graph: (node, root).

    Alternates the two star operations until the edges stand still.  Every round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "cc")


MAX_BITS = 1 << 28  # of a Bloom filter: 32 MB, whatever the number of keys
SLICE_BITS = 1 << 20  # of a filter are set by one task and reach the driver as one value


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each 64-bit key in a filter of ``bits`` bits."""
    return [mix(h + np.uint64(k + 1) * MULT) & np.uint64(bits - 1) for k in range(4)]


def bloom_of(keys: DataFrame, column: str, bits_per_key: int) -> np.ndarray:
    """Bloom filter of a column of longs as an array of words.

    Its size follows the number of keys up to MAX_BITS; with more keys it passes more, so that an exact join must follow.
    Tasks set the bits, a slice each; the driver gets the slices as bytes, file by file, and holds little more than the filter.
    """
    n = keys.agg(F.approx_count_distinct(column)).first()[0]
    bits = 1 << 10
    while bits < min(MAX_BITS, bits_per_key * n):
        bits *= 2
    size = min(bits, SLICE_BITS)
    shift, inside = np.uint64(size.bit_length() - 1), np.uint64(size - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = np.unique(np.concatenate(probes(b.column(0).to_numpy().view(np.uint64), bits)))
            part = (at >> shift).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            off = (4 * np.r_[cut, len(at)]).astype(np.int32)
            held = pa.py_buffer((at & inside).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(off), held])], ["part", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1)):
                at = np.frombuffer(x.as_buffer(), np.uint32)
                if part not in out:
                    out[part] = np.zeros(size >> 6, np.uint64)
                np.bitwise_or.at(out[part], at >> np.uint32(6), np.uint64(1) << (at & np.uint32(63)).astype(np.uint64))
        for part, words in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["part", "words"])

    slices = keys.select(column).mapInArrow(places, "part int, at binary").repartition("part").mapInArrow(fill, "part int, words binary")
    out = np.zeros(bits >> 6, np.uint64)
    for row in materialize(slices, "filter").toLocalIterator():
        first = row["part"] * (size >> 6)
        out[first:first + (size >> 6)] = np.frombuffer(row["words"], np.uint64)
    return out


def may_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in probes(h, len(bloom) << 6):
        ok &= (bloom[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) > 0
    return ok
