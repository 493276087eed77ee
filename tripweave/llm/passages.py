"""Near-duplicate passages by compact windows of min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import MULT, PrefixHash, as_bytes, bloom_of, chunks, components, groups, may_hold, mix, word_bounds

WIDTH = 5  # words of a shingle
SHORTEST = 50  # words of a passage
LEAST = SHORTEST - WIDTH + 1  # shingles of a passage
HASHES = 4
SIMILAR = 0.8
SHIFT = 3  # words that may be inserted or missing in a passage of LEAST shingles
BLOCK = 1 << 20
PAIRS = 1 << 11  # surroundings compared at once
OUTSIDE = 256  # stands for the bytes of places outside
FEW = 64  # rows of a group compared pair by pair


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of WIDTH words (A-Z lower-cased) and offsets of the texts in them."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    space = (low == 32) | ((low >= 9) & (low <= 13))
    s, e, row = word_bounds(~space, off)
    w = PrefixHash(low).of(s, e)
    n = max(len(w) - WIDTH + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h = h * MULT + w[k:k + n]
    inside = row[:n] == row[WIDTH - 1:] if n else np.zeros(0, bool)
    return mix(h)[inside], np.searchsorted(row[:n][inside], np.arange(len(off)))


def compact_windows(hashed: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the Cartesian tree's nodes that span ``least`` values or more.

    All subsequences [i, j] with left <= i <= centre <= j <= right have their smallest value at centre.  The trees of all
    texts are walked level by level; values that no open node spans are left out once they are half of all.
    """
    u = np.r_[(hashed & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashed), dtype=np.uint64), np.uint64(0)]
    l, r = off[:-1], off[1:] - 1
    at = l  # where a node's values start in u
    out = []
    while True:
        keep = r - l + 1 >= least
        l, r, at = l[keep], r[keep], at[keep]
        if not len(l):
            break
        n = r - l + 1
        start = np.cumsum(n) - n
        total = int(start[-1] + n[-1])
        if 2 * total < len(u):
            u = np.append(u[np.repeat(at - start, n) + np.arange(total)], np.uint64(0))
            at = start
        c = (np.minimum.reduceat(u, _between(at, at + n))[::2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out.append((l, c, r))
        l, r, at = _between(l, c + 1), _between(c - 1, r), _between(at, at + (c + 1 - l))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of both in turn."""
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = a, b
    return out


def _centres(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the compact windows of all hash functions with the widest reach to both sides."""
    n = len(g)
    keys = [MULT * np.uint64(2 * k + 1) for k in range(HASHES)]
    hashed = np.concatenate([mix(g ^ k) for k in keys])  # all functions in one walk
    l, c, r = compact_windows(hashed, np.r_[np.concatenate([off[:-1] + k * n for k in range(HASHES)]), HASHES * n])
    base = c // max(n, 1) * n
    c, inv = np.unique(c - base, return_inverse=True)
    left, right = c.copy(), c.copy()
    np.minimum.at(left, inv, l - base)
    np.maximum.at(right, inv, r - base)
    return c, left, right


def _binaries(table: np.ndarray) -> pa.Array:
    """The rows of a table of bytes as a binary column."""
    off = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(table))])


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    """The table of bytes of a binary column whose values are all as long."""
    data, off = as_bytes(column.combine_chunks())
    return data[off[0]:off[-1]].reshape(len(column), -1)


def _rows(docs: DataFrame, bloom: np.ndarray | None = None) -> DataFrame:
    """Signatures of the windows: (g, t); with a filter of signatures those that pass it, with place and the bytes around
    the centre."""
    full = bloom is not None
    shared = docs.sparkSession.sparkContext.broadcast(bloom) if full else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = as_bytes(b.column(1))
            for i, j in chunks(off):
                g, o = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
                c, left, right = _centres(g, o)
                if full:
                    some = may_hold(shared.value, g[c])
                    c, left, right = c[some], left[some], right[some]
                if not len(c):
                    continue
                row = np.searchsorted(o, c, "right") - 1
                cols = [pa.array(g[c].view(np.int64)), b.column(0).take(pa.array(row + i))]
                if full:
                    # one byte of each shingle within reach; bytes outside never agree with anything
                    at = c[:, None] + np.arange(-LEAST, LEAST + 1)[None, :]
                    inside = (at >= left[:, None]) & (at <= right[:, None])
                    near = np.where(inside, g[np.clip(at, 0, len(g) - 1)] >> np.uint64(56), 0).astype(np.uint8)
                    mask = np.packbits(inside, axis=1)
                    cols += [pa.array(c - o[row]), _binaries(near), _binaries(mask)]
                yield pa.RecordBatch.from_arrays(cols, ["g", "t", "place", "near", "mask"][:len(cols)])

    kinds = "g bigint, t bigint" + (", place bigint, near binary, mask binary" if full else "")
    return docs.select("t", "text").mapInArrow(run, kinds)


def _places(near: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surroundings place by place (a row a place, a column a surrounding): the byte, and two values for places outside.

    Places that lie together for all pairs make every comparison of two places one run over memory.  A column of the first
    table is compared with one of the second: outside agrees with nothing.
    """
    byte = near.astype(np.uint16)
    return tuple(np.ascontiguousarray(np.where(mask, byte, np.uint16(outside)).T) for outside in (OUTSIDE, OUTSIDE + 1))


def _span(y: np.ndarray) -> tuple[int, int]:
    """The places that can agree with columns of the second table; outside of them no window holds more hits."""
    inside = np.flatnonzero((y != OUTSIDE + 1).any(axis=1))
    lo, hi = (max(inside[0] - SHIFT, 0), min(inside[-1] + 1 + SHIFT, len(y))) if len(inside) else (0, len(y))
    return (int(lo), int(hi)) if hi - LEAST >= max(lo, 1) else (0, len(y))


def _enough(hit: np.ndarray, lo: int) -> np.ndarray:
    """Whether LEAST places around the centre hold as many hits as a Jaccard similarity of SIMILAR takes; the first is ``lo``."""
    first = max(lo, 1)  # windows that hold the centre start from 1 to LEAST
    n, at = min(LEAST, lo + len(hit) - LEAST) - first + 1, first - lo
    part, width, total = hit.view(np.uint8), 1, np.uint8(0)
    while width <= LEAST:  # sums over 1, 2, 4, ... places make those over LEAST; 2 * LEAST + 1 at most
        if LEAST & width:
            total = total + part[at:at + n]
            at += width
        part, width = part[:-width] + part[width:], 2 * width
    return total.max(axis=0) >= int(np.ceil(2 * SIMILAR / (1 + SIMILAR) * LEAST))


def _alike(x: np.ndarray, y: np.ndarray, lo: int = 0) -> np.ndarray:
    """``agree`` for columns of the two tables, from place ``lo`` on; ``y`` may be one column for all of ``x``."""
    hit = x == y
    there = hit.copy()
    for s in range(1, SHIFT + 1):
        same = x[s:] == y[:-s]
        hit[s:] |= same
        there[:-s] |= same
        same = x[:-s] == y[s:]
        hit[:-s] |= same
        there[s:] |= same
    return _enough(hit, lo) | _enough(there, lo)


def _test(places: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """Whether the surroundings with these numbers agree; ``y`` may be one for all of ``x``."""
    ok = np.zeros(len(x), bool)
    for s in range(0, len(x), PAIRS):
        b = places[1][:, y:y + 1] if np.ndim(y) == 0 else places[1].take(y[s:s + PAIRS], 1)
        lo, hi = _span(b)
        ok[s:s + PAIRS] = _alike(places[0][lo:hi].take(x[s:s + PAIRS], 1), b[lo:hi], lo)
    return ok


def agree(a: np.ndarray, am: np.ndarray, b: np.ndarray, bm: np.ndarray) -> np.ndarray:
    """Whether two surroundings of one shingle hold passages of LEAST shingles around it that are alike to SIMILAR.

    A place agrees if its shingle is on the other side, up to SHIFT words on or back (inserted or missing words).  Of LEAST
    places of either side as many must agree as a Jaccard similarity of SIMILAR takes.
    """
    return _alike(_places(a, am)[0], _places(b, bm)[1])


def _met(group: np.ndarray, near: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Rows of large ``again`` groups that hold the left side most of their group holds: they meet in a group of that side."""
    gid = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    size = np.bincount(gid)
    rows = np.flatnonzero(again & (size[gid] > FEW))
    side = np.ascontiguousarray(near[rows, LEAST - 8:LEAST]).view(np.int64).ravel()
    order = np.lexsort((side, gid[rows]))
    rows, side = rows[order], side[order]
    run = np.cumsum(np.r_[True, (side[1:] != side[:-1]) | (gid[rows[1:]] != gid[rows[:-1]])]) - 1
    out = np.zeros(len(group), bool)
    out[rows] = 2 * np.bincount(run, minlength=1)[run] > size[gid[rows]] if len(rows) else False
    return out


def _across(group: np.ndarray, cls: np.ndarray, places: tuple[np.ndarray, np.ndarray], met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the classes of one group: a link for every two classes with members that agree.

    ``cls`` is the first member of each row's class; rows that were compared with it then are not compared again.  Small
    groups are compared pair by pair, many at a time; in large ones classes that have met are one and are not compared again.
    Rows that are ``met`` are compared with the others of their group, not with each other.
    """
    n = len(group)
    head = np.r_[True, group[1:] != group[:-1]]
    gid, start = np.cumsum(head) - 1, np.flatnonzero(head)
    size = np.diff(np.r_[start, n])
    kinds = np.bincount(gid, cls == np.arange(n)).astype(np.int64)
    mixed = np.flatnonzero((kinds > 1) & (kinds < size) | (np.bincount(gid, met) > 0))
    out = [(np.zeros(0, np.int64),) * 2]

    def fresh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (cls[x] != cls[y]) & ~((cls[x] == x) & (cls[y] >= x))

    few = mixed[size[mixed] <= FEW]
    ends = np.cumsum(size[few] ** 2)
    for part in np.split(few, np.searchsorted(ends, np.arange(4 * PAIRS, ends[-1], 4 * PAIRS)) if len(few) else []):
        m = size[part]
        at = np.arange((m * m).sum()) - np.repeat(np.cumsum(m * m) - m * m, m * m)
        m, first = np.repeat(m, m * m), np.repeat(start[part], m * m)
        x, y = first + at // np.maximum(m, 1), first + at % np.maximum(m, 1)
        keep = x < y
        x, y = x[keep], y[keep]
        keep = fresh(x, y)
        x, y = x[keep], y[keep]
        ok = _test(places, x, y)
        x, y = x[ok], y[ok]
        once = np.unique(cls[x] * n + cls[y], return_index=True)[1]
        out.append((x[once], y[once]))
    for i in mixed[size[mixed] > FEW]:
        rows = np.arange(start[i], start[i] + size[i])
        own = tuple(np.ascontiguousarray(p[:, rows[0]:rows[-1] + 1]) for p in places)
        known, first = met[rows], cls[rows] - rows[0]
        joined, rep = first.astype(np.int32), first == np.arange(len(rows))
        often = np.flatnonzero(known)
        for j in np.flatnonzero(~known):
            apart = joined[:j] != joined[j]
            apart[:first[j] + 1] &= ~rep[:j][:first[j] + 1]
            if len(often):
                apart[often[:np.searchsorted(often, j)]] = False
                at = np.r_[np.flatnonzero(apart), often[joined[often] != joined[j]]]
            else:
                at = np.flatnonzero(apart)
            if not len(at):
                continue
            at = at[_test(own, at, j)]
            if len(at):
                at = at[np.unique(joined[at], return_index=True)[1]]
                out.append((rows[at], np.full(len(at), rows[j])))
                for c in joined[at]:
                    joined[joined == c] = joined[j]
    return tuple(np.concatenate(v) for v in zip(*out))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within whole signature groups, for many groups at once.

    Within a group all are compared with its first member; those that do not agree form the group of the next round.  The
    classes made so are then compared member by member.  ``again`` marks the groups of a right side: rows that also share
    their left side meet in the group of that one as well.
    """
    size = 2 * LEAST + 1

    def block(t: pa.Table) -> pa.RecordBatch:
        g, who, place = (t[c].to_numpy() for c in ("g", "t", "place"))
        near, mask = _bytes_of(t["near"]), np.unpackbits(_bytes_of(t["mask"]), axis=1)[:, :size].view(bool)
        places = _places(near, mask)
        met = _met(g, near, t["again"].to_numpy()) if "again" in t.column_names else np.zeros(len(g), bool)
        left, cls = np.flatnonzero(~met), np.arange(len(g))
        out = []
        while len(left) > 1:
            head = np.r_[True, g[left][1:] != g[left][:-1]]
            rep = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            rest, rep = left[~head], rep[~head]
            ok = _test(places, rest, rep)
            out.append((rest[ok], rep[ok]))
            cls[rest[ok]] = rep[ok]
            left = rest[~ok]
        out.append(_across(g, cls, places, met))
        x, y = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        differ = who[x] != who[y]
        x, y = x[differ], y[differ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (who[x], who[y], place[x], place[y])], ["a", "b", "a_place", "b_place"])

    held, total = [], 0
    for t in groups(batches, ["g"]):
        held.append(t)
        total += t.nbytes
        if total >= BLOCK:
            yield block(pa.concat_tables(held))
            held, total = [], 0
    if held:
        yield block(pa.concat_tables(held))


def passage_links(docs: DataFrame) -> DataFrame:
    """(a, b, a_place, b_place): texts a and b hold alike passages around these shingles.  ``docs``: t, text (distinct)."""
    shared = _rows(docs).groupBy("g").agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x <> y").select("g")
    shared = materialize(shared, "signatures")
    rows = _rows(docs, bloom_of(shared, "g", 16)).join(shared, "g")  # the filter saves moving what the join would drop
    # windows with equal surroundings count once; the others hang on the one with the smallest text
    rows = materialize(rows, "windows")
    once = rows.groupBy("g", "near", "mask").agg(F.min(F.struct("t", "place")).alias("m")).select("g", F.col("m.t").alias("t"), F.col("m.place").alias("place"), "near", "mask")
    once = materialize(once, "distinct-windows")
    part = F.pmod(F.xxhash64(F.substring("near", LEAST - 7, 8)), F.lit(1 << 16))
    part2 = F.pmod(F.xxhash64(F.substring("near", LEAST + 2, 8)), F.lit(1 << 16))
    sides = once.withColumn("side", F.explode(F.array(part, part2 + (1 << 16))))
    sides = sides.select(F.xxhash64("g", "side").alias("g"), "t", "place", "near", "mask", (F.col("side") >= 1 << 16).alias("again"))
    sides = sides.repartition("g").sortWithinPartitions("g", "t", "place")
    links = sides.mapInArrow(_link, "a bigint, b bigint, a_place bigint, b_place bigint")
    same = rows.join(once.select("g", "near", "mask", F.col("t").alias("b"), F.col("place").alias("b_place")), ["g", "near", "mask"]).where("t <> b")
    return links.unionByName(same.select(F.col("t").alias("a"), "b", F.col("place").alias("a_place"), "b_place"))


def near_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_signatures, first_word, last_word) of every document that shares a passage with another one.

    A passage has SHORTEST words or more; two are alike if their sets of WIDTH-word shingles have a similarity of SIMILAR.
    Windows of the Cartesian trees of HASHES min-hash functions name the subsequences that share a signature.  Those
    that share it, and eight shingles on one side of it, are compared around it.  class_id is the smallest doc_id reachable;
    the words span the signatures found.  Equal texts of SHORTEST words count as sharing one; shorter, empty and null
    texts have no passage.  Repeated rows share their text with each other only if their doc_ids differ.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("t", F.xxhash64(text))
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    long_enough = F.col("text").rlike(rf"\A{space}*+(?:{word}++{space}++){{{SHORTEST - 1}}}{word}")  # stops at the last word needed
    copies = materialize(rows.groupBy("t").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(long_enough).alias("long")), "texts")
    links = materialize(passage_links(rows), "passage-links")
    comp = components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("t"), F.col("a_place").alias("p")).unionAll(links.select("b", "b_place"))
    ends = ends.groupBy("t").agg(F.countDistinct("p").alias("n_signatures"), F.min("p").alias("first_word"), (F.max("p") + WIDTH - 1).alias("last_word"))
    known = copies.join(ends, "t", "left").join(comp.withColumnRenamed("node", "t"), "t", "left")
    known = known.where("n_signatures IS NOT NULL OR (long AND low <> high)").withColumn("root", F.coalesce("root", "t"))
    known = materialize(known, "passage-texts")
    named = known.groupBy("root").agg(F.min("low").alias("class_id"))
    known = materialize(known.join(named, "root").select("t", "class_id", "n_signatures", "first_word", "last_word"), "passage-classes")
    return rows.select("doc_id", "t").join(known, "t").select("doc_id", "class_id", F.coalesce("n_signatures", F.lit(0)).alias("n_signatures"),
                                                              "first_word", "last_word")
