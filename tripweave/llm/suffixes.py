"""Repeated byte strings, found by sorting suffixes block by block with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import as_bytes, chunks, groups, mix, numbered

GRAM = 40  # bytes of an anchor
PERIOD = 31  # of the difference cover
BLOCK = 1 << 20  # bytes of suffix text that one block sorts
HOT = 8192  # distinct surroundings from which an anchor's windows are spread over the cluster
SEGMENT = 1 << 22  # longer texts are cut in overlapping segments


def difference_cover(period: int) -> np.ndarray:
    """A small set of residues whose pairwise differences are all residues (smallest size, first in order)."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            d = (0, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return np.array(d)
        size += 1


def _shifts(cover: np.ndarray, period: int) -> np.ndarray:
    """shift[a, b]: the least d for which a + d and b + d are both in the cover."""
    inside = np.zeros(period, bool)
    inside[cover] = True
    at = (np.arange(period)[:, None] + np.arange(period)[None, :]) % period  # residue of a + d
    both = inside[at][:, None, :] & inside[at][None, :, :]
    return both.argmax(axis=2)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by ``keys``, the first the most significant."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), np.int64)
    for k in keys:
        step[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int, cover: np.ndarray, period: int = PERIOD) -> np.ndarray:
    """Which of the strings text[s:s + length], s in ``starts``, occur at another start too.

    Cover samples are ranked to a depth of at least length + period by doubling.  The suffixes at ``starts`` are sorted by
    their first 32 bytes; ties are split three ways around a pivot, comparing the ranks of the samples that both
    suffixes meet at the same distance.  Neighbours in the sorted order that share ``length`` bytes are repeats.
    """
    n, m = len(text), len(starts)
    dup = np.zeros(m, bool)
    if m < 2:
        return dup
    word = np.zeros(n + 2 * length + 8 * period, np.uint64)  # eight bytes from each position on, zeros behind the end
    word[:n] = text
    for s in (1, 2, 4):
        word[:-s] = (word[:-s] << np.uint64(8 * s)) | word[s:]
    reach = n + length + period
    sample = np.flatnonzero(np.isin(np.arange(reach) % period, cover))
    rank = np.zeros(reach + 2 * (length + 4 * period), np.int64)
    rank[sample] = _ranks(*(word[np.minimum(sample + 8 * k, len(word) - 1)] for k in range(4))) + 1
    depth = period
    while depth < length + period:
        rank[sample] = _ranks(rank[sample], rank[np.minimum(sample + depth, len(rank) - 1)]) + 1
        depth *= 2
    shift = _shifts(cover, period)
    order = np.lexsort(tuple(word[starts + 8 * k] for k in (3, 2, 1, 0)))
    pos = starts[order]
    new = np.zeros(m, bool)
    for k in range(4):
        w = word[pos + 8 * k]
        new[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new)
    same = np.zeros(m, bool)  # equal to the one before, by rank
    size = np.bincount(group)
    live = np.flatnonzero(size[group] > 1)
    while len(live):
        g = group[live]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(np.r_[head, len(g)])
        pivot = np.repeat(pos[live[head + count // 2]], count)
        p = pos[live]
        d = shift[p % period, pivot % period]
        side = np.sign(rank[p + d] - rank[pivot + d])
        within = np.repeat(np.arange(len(head)), count)
        turn = np.argsort(within * 3 + side + 1, kind="stable")
        key = (within * 3 + side + 1)[turn]
        order[live], pos[live] = order[live[turn]], p[turn]
        edge = np.r_[True, key[1:] != key[:-1]]
        part = np.cumsum(edge) - 1
        settled = key % 3 == 1
        same[live[settled & ~edge]] = True
        keep = ~settled & (np.bincount(part)[part] > 1)
        group[live] = part  # only equality within the live ones matters from here on
        live = live[keep]
    equal = same.copy()
    left = np.flatnonzero(~same[1:]) + 1
    for k in range(0, length, 8):
        if not len(left):
            break
        a, b = word[pos[left] + k], word[pos[left - 1] + k]
        if length - k < 8:
            drop = np.uint64(8 * (8 - (length - k)))
            a, b = a >> drop, b >> drop
        left = left[a == b]
    equal[left] = True
    dup[order[equal]] = True
    dup[order[np.flatnonzero(equal) - 1]] = True
    return dup


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 32 + 8 bytes from each position on."""
    h = data.astype(np.uint64) + np.uint64(1)
    eight = h
    for k, s in enumerate((1, 2, 4, 8, 16)):
        h = h[:-s] * np.uint64(0x9E3779B97F4A7C15 + 2 * 7919 * k) + h[s:]
        if s == 4:
            eight = h
    n = len(data) - GRAM + 1
    return mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + eight[32:32 + n])


def anchors_of(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest gram (the first of equals): (hash, gram, first window, last window).

    Equal windows have their smallest gram at the same place, so a repeated window has a repeated anchor.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    room = np.maximum(np.diff(off) - length + 1, 0)
    if not room.sum():
        return none
    g = _grams(data)
    low = np.uint64((1 << 24) - 1)
    u = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    w = length - GRAM + 1
    rows = -(-len(u) // w) + 1
    pad = np.full(rows * w, ~np.uint64(0))
    pad[:len(u)] = u
    pad = pad.reshape(rows, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.repeat(off[:-1] - np.r_[0, np.cumsum(room)[:-1]], room) + np.arange(room.sum())
    at = (np.minimum(back[start], ahead[start + w - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return g[at[first]], at[first], start[first], start[last]


def _segments(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: (first row, last row + 1, offset in the row, bytes, offsets)."""
    for i, j in chunks(off, 1 << 18):
        size = int(off[j] - off[i])
        for s in range(0, max(size, 1), SEGMENT):
            part = data[off[i] + s:min(off[j], off[i] + s + SEGMENT + length - 1)]
            yield i, j, s, part, off[i:j + 1] - off[i] if size <= SEGMENT else np.array([0, len(part)])
            if size <= SEGMENT:
                break


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = as_bytes(b.column("__text"))
            for i, j, s, part, o in _segments(data, off, length):
                h, p, first, last = anchors_of(part, o, length)
                if len(h):
                    row = np.searchsorted(o, p, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), b.column("__tid").take(pa.array(row + i)), pa.array(first - o[row] + s),
                         pa.array((p - first).astype(np.int16)), pa.array((last - first).astype(np.int16))],
                        ["h", "tid", "start", "lead", "more"])

    return docs.select("__tid", "__text").mapInArrow(run, "h bigint, tid binary, start bigint, lead smallint, more smallint")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted run of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = as_bytes(b.column("__text"))
            hits = b.column("hits")
            for i, j in chunks(off, 1 << 22):
                part = hits.slice(i, j - i)
                rows = np.repeat(np.arange(i, j), np.asarray(part.value_lengths()))
                h, start, lead, more = part.flatten().flatten()
                s = np.asarray(start) + off[rows]
                size = np.asarray(more).astype(np.int64) + length
                o = np.r_[0, np.cumsum(size)]
                take = np.repeat(s - o[:-1], size) + np.arange(o[-1])
                ctx = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(o), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays([h, b.column("tid").take(pa.array(rows)), start, lead, more, ctx.cast(pa.binary())],
                                                 ["h", "tid", "start", "lead", "more", "ctx"])

    return texts.select("tid", "__text", "hits").mapInArrow(
        run, "h bigint, tid binary, start bigint, lead smallint, more smallint, ctx binary")


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows in each distinct context of whole anchor groups."""
    cover = difference_cover(PERIOD)

    def block(part: pa.Table) -> pa.RecordBatch:
        h = part["h"].to_numpy()
        known = part["known"].to_numpy(zero_copy_only=False).astype(bool)
        new = np.r_[True, h[1:] != h[:-1]]
        g = np.cumsum(new) - 1
        open_ = (np.bincount(g)[g] > 1) & (np.bincount(g, ~known)[g] > 0)
        width = part["more"].to_numpy().astype(np.int64) + 1
        data, off = as_bytes_of(part["ctx"].combine_chunks())
        rows = np.flatnonzero(open_)
        size = off[rows + 1] - off[rows]
        o = np.r_[0, np.cumsum(size)]
        text = data[np.repeat(off[rows] - o[:-1], size) + np.arange(o[-1])]
        w = width[rows]
        first = np.r_[0, np.cumsum(w)]
        starts = np.repeat(o[:-1] - first[:-1], w) + np.arange(first[-1])
        dup = repeated(text, starts, length, cover)
        owner = np.repeat(rows, w)
        dup |= known[owner]
        local = starts - np.repeat(o[:-1], w)
        edge = np.r_[True, (owner[1:] != owner[:-1]) | (dup[1:] != dup[:-1])] if len(owner) else np.zeros(0, bool)
        a = np.flatnonzero(edge)
        z = np.r_[a[1:], len(owner)] - 1 if len(a) else a
        pick = dup[a]
        whole = np.flatnonzero(~open_ & known)
        who = np.r_[owner[a[pick]], whole]
        lo, hi = np.r_[local[a[pick]], np.zeros(len(whole), np.int64)], np.r_[local[z[pick]], width[whole] - 1]
        return pa.RecordBatch.from_arrays([pa.array(h[who]), part["c"].combine_chunks().take(pa.array(who)), pa.array(lo), pa.array(hi)],
                                          ["h", "c", "lo", "hi"])

    held: list[pa.Table] = []
    total = 0
    for t in groups(batches, ["h"]):
        held.append(t)
        total += t.nbytes
        if total >= BLOCK:
            yield block(pa.concat_tables(held))
            held, total = [], 0
    if held:
        yield block(pa.concat_tables(held))


def as_bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), off


def _hot_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digest of every window of the contexts of hot anchors, with its place relative to the anchor."""
    for b in batches:
        h, c, lead, more, known = (b.column(k).to_pylist() for k in ("h", "c", "lead", "more", "known"))
        out = []
        for k, ctx in enumerate(b.column("ctx")):
            v = ctx.as_py()
            out += [(h[k], c[k], known[k], a, a - lead[k], hashlib.blake2b(v[a:a + length], digest_size=16).digest()) for a in range(more[k] + 1)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))],
                ["h", "c", "known", "a", "r", "w"])


def spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """Repeated windows: (tid, spans) for every distinct text that has some; spans are [start, end) bytes.

    ``docs`` has ``__tid`` (a digest of the text), ``__id`` and ``__text``.  Equal texts count once here; the caller
    knows their number.  Steps: anchors of all windows; anchors that occur at two places; the texts around these; equal
    surroundings count once and are repeats as a whole; the windows of the rest are sorted in blocks of whole anchor
    groups.  Windows of an anchor with more than HOT different surroundings are spread by a digest of their own bytes.
    """
    anchors = materialize(_anchor_rows(docs, length), "anchors")
    place = F.xxhash64("tid", F.col("start") + F.col("lead"))
    often = anchors.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h")
    often = materialize(often, "often")  # a join of two plain shuffles, which Spark can split at a hot anchor
    hits = anchors.join(often, "h").groupBy("tid").agg(F.collect_set(F.struct("h", "start", "lead", "more")).alias("hits"))
    ids = docs.groupBy(F.col("__tid").alias("tid")).agg(F.min("__id").alias("first_id"))
    hits = hits.join(ids, "tid")
    texts = docs.join(hits, (F.col("__tid") == F.col("tid")) & F.col("__id").eqNullSafe(F.col("first_id")))
    found = _contexts(texts, length).withColumn("c", F.xxhash64("lead", "ctx"))
    found = materialize(found, "contexts")
    once = found.groupBy("h", "c", "lead", "more", "ctx").agg(F.min(place).alias("x"), F.max(place).alias("y"))
    once = once.withColumn("known", F.expr("x <> y")).drop("x", "y")
    hot = materialize(found.select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"), "hot-anchors")
    calm = once.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    runs = calm.select("h", "c", "more", "known", "ctx").mapInArrow(
        lambda it: _sort_buckets(it, length), "h bigint, c bigint, lo bigint, hi bigint")
    if not hot.isEmpty():
        win = once.join(hot, "h").mapInArrow(lambda it: _hot_windows(it, length), "h bigint, c bigint, known boolean, a bigint, r bigint, w binary")
        win = materialize(win, "hot-windows")
        shared = win.groupBy("h", "r", "w").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.max("known").alias("k"))
        shared = shared.where("x <> y OR k").select("h", "r", "w")
        runs = runs.unionByName(win.join(shared, ["h", "r", "w"]).select("h", "c", F.col("a").alias("lo"), F.col("a").alias("hi")))
    places = found.select("h", "c", "tid", "start").distinct().join(runs, ["h", "c"])
    span = F.struct((F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + length).alias("e"))
    return places.groupBy("tid").agg(F.collect_list(span).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, size, kept, digest = [], [], [], []
        for text, all_, sp in zip(b.column("__text"), b.column("__whole").to_pylist(), b.column("spans")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if all_:
                merged, out = [(0, len(raw))], b""
            else:
                merged = []
                if sp.is_valid and len(sp.values):
                    s, e = (np.asarray(x) for x in sp.values.flatten())
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    merged = list(zip(s[cut].tolist(), e[np.r_[cut[1:], len(e)] - 1].tolist()))
                parts, last = [], 0
                for x, y in merged:
                    parts.append(raw[last:x])
                    last = y
                out = b"".join([*parts, raw[last:]])
            at.append(len(merged))
            size.append(len(raw) - len(out))
            kept.append(out)
            digest.append(hashlib.sha256(out).hexdigest())
        cols = [b.column(k) for k in names] + [pa.array(size, pa.int64()), pa.array(at, pa.int64()), pa.array(digest)]
        if with_text:
            cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept]))
        yield pa.RecordBatch.from_arrays(cols, [*names, "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])])


def cut_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else in ``docs``.

    Returns the columns of ``docs`` (without ``text``), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with ``with_text``, kept_text, in which cut characters are left out.  Texts are whole UTF-8 bytes; null counts as
    empty; matches never cross documents; strings are judged on the input.  A text that occurs twice loses everything if
    it has ``length`` bytes.  Repeated rows are copies of each other.  Other columns stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    names = [c for c in docs.columns if c != "text"]
    rows = docs.withColumns({"__text": text, "__tid": F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16), "__id": F.col("doc_id")})
    copies = rows.groupBy("__tid").agg(F.count("*").alias("__n")).where("__n > 1")
    found = spans(rows.select("__text", "__tid", "__id"), length)
    found = materialize(copies.join(found.withColumnRenamed("tid", "__tid"), "__tid", "full"), "spans")
    joined = rows.join(found, "__tid", "left").withColumns(
        {"n_bytes": F.octet_length("__text").cast("bigint"), "__whole": (F.coalesce("__n", F.lit(1)) > 1) & (F.octet_length("__text") >= length)})
    keep = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"]
                      + ["kept_text string"] * with_text)
    names = [*names, "n_bytes"]
    return joined.select(*names, "__text", "__whole", "spans").mapInArrow(lambda it: _cut(it, names, with_text), kinds)


def clean_texts(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of ``text`` and ``n_chars``, if there, counted anew.

    A null text stays null.  A text that is nothing but repeats becomes empty.  Other columns may have any name.
    """
    rows = numbered(docs, "doc_id", "text", "n_chars")
    cut = cut_repeats(rows.withColumn("is_null", F.col("text").isNull()), length, with_text=True)
    out = {"text": F.when(~F.col("is_null"), F.col("kept_text")),
           "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    if "n_chars" in docs.columns:
        out["n_chars"] = out["n_chars"].cast(docs.schema["n_chars"].dataType)
    return cut.select(*(out[c].alias(c) if c in out else F.col(c) for c in rows.columns)).toDF(*docs.columns)
