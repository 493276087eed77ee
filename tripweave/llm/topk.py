"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

SAMPLE = 1024  # rows from which pivots are chosen and first thresholds taken
PIVOTS = 32
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
SLAB = 1024  # candidates that are evaluated between two tests for the stop
EXACT = 1 << 53  # products below this are exact in doubles
LARGE = 1e15  # components from here on are bounded in double precision


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component as a whole double; rows with a null key or vector, or a null or non-finite
    component (also after the scaling), are left out, and repeated rows count once."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # a double of 2**53 or more is whole already, and may lie beyond what floor gives as a long
    v = F.transform(x, lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(key).cast("bigint").alias("id"), v.alias("v")).distinct()


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dim`` columns; shorter vectors are filled with zeros."""
    size = np.diff(np.asarray(col.offsets))
    flat = col.flatten().to_numpy()
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    if top < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(_whole(a) @ _whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole doubles, exact; beyond a long the nearest long.

    By doubles where these are exact; only rows with large components are multiplied as Python integers.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        small_a, small_b = (np.abs(m).max(1, initial=0) ** 2 * m.shape[1] < EXACT for m in (a, b))
    for i in (np.flatnonzero(small_a), np.flatnonzero(~small_a)):
        for j in (np.flatnonzero(small_b), np.flatnonzero(~small_b)):
            if len(i) and len(j):
                out[np.ix_(i, j)] = _product(a[i], b[j])
    return out


def _far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each one is the row farthest from those before it."""
    x = rows / max(1.0, float(np.abs(rows).max(initial=0)))  # no square of a large component overflows
    pick = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(pick) < min(n, len(x)):
        k = int(near.argmax())
        pick.append(k)
        near = np.minimum(near, np.linalg.norm(x - x[k], axis=1))
    return rows[pick]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        sq = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
        return np.sqrt(np.maximum(sq, 0))


def _blocks(rows: DataFrame, per_block: int, pivots: np.ndarray, dim: int) -> DataFrame:
    """Rows gathered in blocks of about ``per_block``: (block, ids, v, dist), the pivot table beside the vectors."""
    n = max(1, -(-rows.count() // per_block))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows

    def pack(key, t):
        v = _matrix(t["v"].combine_chunks(), dim)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": [t["id"].to_numpy().tobytes()], "v": [v.tobytes()],
                         "dist": [_distances(v, shared.value).tobytes()]})

    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("bigint").alias("block")
    return rows.select(block, "id", "v").groupBy("block").applyInArrow(pack, "block bigint, ids binary, v binary, dist binary")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(batches: Iterator[pa.RecordBatch], k: int, dim: int, pivots: int) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore", invalid="ignore")
    for b in batches:
        for row in b.to_pylist():
            def part(name, kind, cols):
                return np.frombuffer(row[name], kind).reshape(-1, cols) if cols else np.frombuffer(row[name], kind)

            qid, ids = part("q_ids", np.int64, 0), part("ids", np.int64, 0)
            q, x = part("q_v", np.float64, dim), part("v", np.float64, dim)
            dq, dx = part("q_dist", np.float64, pivots), part("dist", np.float64, pivots)
            floor_ = part("floor", np.int64, 0)
            wide = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
            exact = wide * wide * dim < EXACT
            if wide < LARGE:
                dq, dx = dq.astype(np.float32), dx.astype(np.float32)
            dx = np.ascontiguousarray(dx.T)
            nq, nx = (q * q).sum(1), (x * x).sum(1)
            out = []
            for j in range(len(qid)):
                gap = np.abs(dx - dq[j][:, None]).max(axis=0)  # lower bound of the distance, the best of all pivots
                gap = np.maximum(gap.astype(float) * (1 - 1e-5) - 1e-5 * dq[j].max(), 0)  # what single precision may have added
                most = (nq[j] + nx - gap * gap) / 2
                most = np.minimum(most, np.sqrt(nq[j]) * np.sqrt(nx))
                most += 1e-9 * (nq[j] + nx) + 1e-6
                if wide >= LARGE:
                    most = np.where(np.isnan(most), np.inf, most)  # a square that overflowed bounds nothing
                may = np.flatnonzero((most >= floor_[j]) & (ids != qid[j]))
                may = may[np.argsort(-most[may], kind="stable")]
                got_s, got_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for s in range(0, len(may), SLAB):
                    if len(got_s) == k and most[may[s]] < got_s[-1]:
                        break  # nothing behind can reach the k-th score
                    c = may[s:s + SLAB]
                    score = (x[c] @ q[j]).astype(np.int64) if exact else dots(q[j:j + 1], x[c])[0]
                    fit = score >= (got_s[-1] if len(got_s) == k else floor_[j])
                    got_s, got_i = top_of(np.r_[got_s, score[fit]], np.r_[got_i, ids[c[fit]]], k)
                out.append((np.full(len(got_s), qid[j]), got_i, got_s))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])


def search(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every``, the ``k`` highest inner products of
    whole-number vectors among all rows with another key; ties to the smaller vec_id.

    The distances of every row to PIVOTS pivots are stored beside it.  Two rows are at least as far apart as their distances
    to any pivot differ, which bounds their inner product from above.  Candidates are taken in the order of this bound
    until the k-th score found is above it; a first floor comes from SAMPLE rows.  Blocks of queries meet all blocks
    of rows.  Pivots and floor are chosen from the SAMPLE rows with the smallest hash of their key; the index holds
    all rows.  Vectors of different length are compared with zeros in the missing places, empty ones give products of 0.
    Products are exact up to a long; one beyond it counts, and is returned, as the nearest long.  A key with two different
    vectors has both, as a query and as a candidate.  Rows with a null key, a null vector or component, or one that is not
    finite take no part; no rows or one row give no result, fewer rows than ``k`` all others.
    """
    spark = rows.sparkSession
    base = materialize(whole_vectors(rows, key, vector), "vectors")
    dim = base.agg(F.max(F.greatest(F.size("v"), F.lit(1)))).first()[0]  # an empty vector is a zero
    schema = "query_id bigint, vec_id bigint, score bigint"
    if dim is None:
        found = base.where(F.lit(False)).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
        return found.withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    first = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(first["v"].combine_chunks(), dim), first["id"].to_numpy()
    pivots = _far_apart(sample, PIVOTS)
    held = spark.sparkContext.broadcast((sample, sample_ids))  # SAMPLE rows

    index = materialize(_blocks(base, ROWS_PER_BLOCK, pivots, dim), "pivot-index")
    asked = _blocks(base.where(F.col("id") % every == 0), QUERIES_PER_BLOCK, pivots, dim)

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, ids = held.value
        for b in batches:
            low = []
            for v, q in zip(b.column("v"), b.column("ids")):
                score = dots(np.frombuffer(v.as_py()).reshape(-1, dim), s)
                own = np.frombuffer(q.as_py(), np.int64)[:, None] == ids[None, :]
                score = np.where(own, np.iinfo(np.int64).min, score)
                kth = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(score), np.iinfo(np.int64).min)
                low.append(kth.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("ids", "v", "dist")] + [pa.array(low, pa.binary())], ["q_ids", "q_v", "q_dist", "floor"])

    asked = asked.mapInArrow(with_floor, "q_ids binary, q_v binary, q_dist binary, floor binary")
    asked = materialize(asked, "pivot-queries")
    n = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    pieces = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))))
    pieces = pieces.repartition(max(1, min(int(asked.count()) * (n + 1), 10_000)), "block", F.xxhash64("q_ids"))
    met = pieces.join(index, "block").mapInArrow(lambda it: _search(it, k, dim, len(pivots)), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
