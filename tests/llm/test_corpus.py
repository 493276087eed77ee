"""Corpus operators on small tables with nulls, empty and repeated rows, against brute force or SQL."""

import base64
import collections
import hashlib
import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tripweave.llm import decontaminate, lm, mixing, passages, q_mixing, quality, simhash, suffixes, topk, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __tid2 string, score double"
RNG = np.random.default_rng(3)
LONG = " ".join("w%d" % x for x in RNG.integers(0, 5000, 400))
OTHER = " ".join("v%d" % x for x in RNG.integers(0, 5000, 400))
TEXTS = [LONG, LONG, OTHER + " " + LONG[:900], LONG.replace(LONG[50:60], "x", 1), "", None, "one", "one", "ab cd", "é ü " * 90, OTHER[300:]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "src%d" % (k % 3), len(t or ""), "x", 1.0) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], (None, LONG[:700], None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash_equals_all_pairs(docs, none):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [(r.doc_id, simhash.vote(simhash.shingle_hashes(r.text, 3))) for r in docs.collect()]
    root = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if bin(a ^ b).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    low = collections.defaultdict(list)
    for (d, _), r in zip(fps, root):
        low[r] += [d] if d is not None else []
    for (d, f), r in zip(fps, root):
        assert got[d, f - (1 << 64) if f >> 63 else f] == min(low[r], default=None)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {min(v) for v in low.values() if v} | ({None} if any(not v for v in low.values()) else set())
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(want, key=str)


def test_bit_sliced_distances():
    fps = RNG.integers(0, 2**63, 150).astype(np.uint64)
    fps[7] = fps[3] ^ np.uint64(0b1011)
    fps[9] = fps[3] ^ np.uint64(0b1111)
    planes = simhash.bit_planes(fps)
    valid = np.array([~np.uint64(0), ~np.uint64(0), np.uint64((1 << 22) - 1)])
    block = np.repeat([0, 1, 2], 150)
    for radius in (1, 2, 3, 5):
        q, lane = simhash.near_lanes(np.tile(fps, 3), planes, valid, block, radius)
        got = {(int(a) % 150, int(block[a] * 64 + b)) for a, b in zip(q, lane)}
        assert got == {(i, j) for i in range(150) for j in range(150) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}


def _cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        m = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                m[i:i + length] = True
        kept = np.frombuffer(x, np.uint8)[~m].tobytes()
        out.append((len(x), int(m.sum()), int((m & ~np.r_[False, m[:-1]][:len(m)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8192, 1])
def test_suffix_dedup_equals_brute_force(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *c) for r, c in zip(rows, _cut([r.text for r in rows], 200)))
    got = suffixes.cut_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert suffixes.cut_repeats(none, 200).count() == 0
    assert suffixes.clean_texts(docs, 200).columns == docs.columns


def test_suffix_sort_with_ties():
    cover = suffixes.difference_cover(31)
    assert len({(a - b) % 31 for a in cover for b in cover}) == 31
    text = np.r_[np.full(300, 97), RNG.integers(97, 99, 300), np.full(300, 97)].astype(np.uint8)
    starts = np.arange(len(text) - 60)
    seen = collections.Counter(text[s:s + 60].tobytes() for s in starts)
    assert (suffixes.repeated(text, starts, 60, cover) == [seen[text[s:s + 60].tobytes()] > 1 for s in starts]).all()


def test_decontamination(spark, docs, none):
    words = OTHER.split()[100:130]
    edited = words[:9] + ["zz"] + words[10:20] + words[21:]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, "no such words are in any text of these"), (4, None), (5, "one"), (None, "")],
                                  "item_id bigint, text string")
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(90, "a b c d " + " ".join(edited).upper() + " e f g")], "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(more, items).collect()}
    assert set(got) == {(d, i) for d in (2, 10, 90) for i in (1, 2)}
    assert got[2, 1] == 1.0 and 0.8 < got[90, 1] < 1.0
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_leaking(docs, items).collect()} == {None, 0, 1, 3, 4, 5, 6, 7, 8, 9}


def test_mixing_budgets_and_rows(docs, none):
    got = mixing.mix(docs, q_mixing.domain(), q_mixing.WEIGHTS, 1.0, 2, 7)
    rows = got.collect()
    total = sum(len((t.text or "").split()) for t in docs.collect())
    assert sum(r.full_epochs * r.n_tokens + r.last_tokens for r in rows) == total
    assert mixing.mix(none, q_mixing.domain(), q_mixing.WEIGHTS).count() == 0


def test_quality(spark, docs, none):
    good = [(k, LONG[k:k + 300], 1) for k in range(40)]
    bad = [(100 + k, "!! $$$ " * (3 + k), 0) for k in range(40)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    labels = table.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (3, None), (999, 0)], "doc_id bigint, quality int"))
    got = {r.doc_id: r for r in quality.classify(table.drop("quality"), labels).collect()}
    assert all(got[k].predicted == q and 0 <= got[k].score <= 1 for k, _, q in good + bad)
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(none, labels).count() == 0
    assert [r.score for r in quality.classify(docs, labels.limit(0)).select("score").distinct().collect()] == [pytest.approx(0.3)]


def test_quality_learns_from_every_labelled_row(spark):
    n = 30_000
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    rare = rows.where("doc_id % 3 = 0").orderBy(F.desc(h)).first().doc_id  # the only row with feature 5, last in the order of the hash
    labelled = rows.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"), F.array(*[
        (F.col("doc_id") == rare).cast("double") if k == 5 else F.rand(k) for k in range(len(quality.FEATURES))]).alias("__features"))
    m = quality.fit(labelled)
    assert m.weights[5] > 0
    assert quality.fit(labelled) == m


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/b\r\nc", "x" * 100_000), (3, None, "same"), (4, "u", "same"), (4, "t", "same"), (9, "u", None), (7, "u", ""), (None, "u", "same"),
            (3, "z", "same"), (3, "z", "same"), (12, "u", "WARC/1.1 \x1f\u00e9")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kind = "revisit" if raw in first else "response"
        first.setdefault(raw, p)
        want[p, len(raw), sha, kind, first[raw] if kind == "revisit" else None] += 1
    assert got == want
    folder = str(tmp_path / "w")
    files = warc.write(pages, folder)
    for split in (7, 64, 1 << 22):
        assert warc.read(spark, folder, files, split).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/")]
    pages = spark.createDataFrame([(1, "http://WWW.Example.org/es/a?x#y"), (2, "https://example.org/en"), (3, "nohost"), (4, None), (5, "http://q.net/a/?utm_a=1"),
                                   (6, "x://q.net/a#z"), (7, "http://myorg/"), (8, "http://b.com/de/")], "page_id bigint, url string")
    listed = spark.createDataFrame([("https://www.q.net/a",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, rules).collect()}
    assert got == {1: ("www.example.org", "/es/a", "example.org/es/", "block"), 2: ("example.org", "/en", "org/", "allow"), 3: ("", "", None, "allow"),
                   4: ("", "", None, "allow"), 5: ("q.net", "/a/", None, "block"), 6: ("q.net", "/a", None, "block"), 7: ("myorg", "/", None, "allow"),
                   8: ("b.com", "/de/", "com/de/", "block")}
    assert url_filter.judge(pages, listed.limit(0), rules).where("listed").count() == 0


def test_topk_edges(spark):
    rows = [(k, [float(x) for x in RNG.normal(size=5)]) for k in range(60)] + [(60, None), (61, [float("nan")] * 5), (62, [1.0, None, 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(table, every=20, k=5).collect()}
    v = {k: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for k, x in rows[:60]}
    for q in (0, 20, 40):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        assert [got[q, i + 1] for i in range(5)] == [(c, -s) for s, c in best]
    assert len(got) == 15
    assert topk.search(table.limit(0)).count() == 0


def test_topk_of_large_short_and_empty_vectors(spark, monkeypatch):
    """Every finite vector takes part: products beyond doubles, beyond a long, ties, few rows and empty vectors."""
    monkeypatch.setattr(topk, "SLAB", 2)
    rows = [(0, [1e17, 3.0]), (1, [2e17, -5.0]), (2, [0.5, 0.25]), (3, [0.5, 0.25]), (4, []), (5, [1e300, -1e300]), (6, [-3e5 - 1 / 64]),
            (7, [123456789.015625, 987654321.0]), (8, [1.7e308, 0.0]), (20, [3.0, 1e9]), (40, [0.0, -7e4]), (60, [1e160, 2e160])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = {k: [math.floor(64 * c) for c in x] for k, x in rows if k != 8}  # 64 times row 8 is no finite double
    want = {}
    for q in (0, 20, 40, 60):
        near = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[c])))), c) for c in v if c != q)
        want.update({(q, r + 1): (c, -n) for r, (n, c) in enumerate(near)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(table, every=20, k=20).collect()}
    assert got == want
    few = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(table, every=20, k=3).collect()}
    assert few == {k: x for k, x in want.items() if k[1] <= 3}
    empty = spark.createDataFrame([(k, []) for k in range(22)], "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(empty).collect())
    assert got == sorted((q, r + 1, c, 0) for q in (0, 20) for r, c in enumerate([c for c in range(22) if c != q][:20]))


@pytest.mark.parametrize("size", [50_000, 20])
@pytest.mark.parametrize("hot", [1 << 14, 3, 1 << 40])
def test_language_model_equals_brute_force(docs, none, spark, size, hot, monkeypatch):
    monkeypatch.setattr(lm, "HOT", hot)
    targets = spark.createDataFrame([(0,), (0,), (None,), (77,), (10,)], "doc_id bigint")
    rows = [(r.doc_id, lm.words_of(r.text)) for r in docs.collect()]
    seen = collections.Counter(w for _, ws in rows for w in ws)
    known = set(sorted(seen, key=lambda w: (-seen[w], w))[:size])
    rows = [(d, [w if w in known else "?" for w in ws]) for d, ws in rows]
    width = len(known) + 1
    models = []
    for chosen in ([ws for d, ws in rows if d in (0, 10)], [ws for _, ws in rows]):
        models.append((collections.Counter(w for ws in chosen for w in ws) + collections.Counter("" for ws in chosen if ws),
                       collections.Counter(p for ws in chosen for p in zip(["", *ws], ws)), sum(map(len, chosen))))

    def mean(ws, uni, pairs, total):
        return np.mean([-np.log2((pairs[a, b] + lm.STRENGTH * (uni[b] + 1) / (total + width)) / (uni[a] + lm.STRENGTH)) for a, b in zip(["", *ws], ws)])

    want = collections.Counter((d, len(ws), *((round(mean(ws, *m), 4) for m in models) if ws else (None, None))) for d, ws in rows)
    got = lm.score(docs, targets, size).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, *(x if x is None else round(x, 4) for x in (r.target_loss, r.background_loss))) for r in got) == want
    assert all(r.score is None if not r.n_tokens else r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)


def test_language_model_edges(docs, none, spark):
    targets = spark.createDataFrame([(0,), (None,), (77,)], "doc_id bigint")
    got = {r.doc_id: r for r in lm.score(docs, targets).collect()}
    assert got[0].score < got[10].score and got[5].score is None and got[4].n_tokens == 0
    assert lm.score(none, targets).count() == 0 and lm.score(docs, targets.limit(0)).count() == docs.count()


def test_passages(docs, none):
    got = {r.doc_id: r.class_id for r in passages.near_passages(docs).collect()}
    assert {d: c for d, c in got.items() if d is not None} == {0: 0, 1: 0, 2: 0, 3: 0, 10: 0}
    assert passages.near_passages(none).count() == 0


def test_compact_windows_cover_every_subsequence_once():
    h = RNG.integers(0, 2**63, 90).astype(np.uint64)
    l, c, r = passages.compact_windows(h, np.array([0, 50, 90]), 10)
    for lo, hi in ((0, 50), (50, 90)):
        for i in range(lo, hi):
            for j in range(i + 9, hi):
                hit = np.flatnonzero((l <= i) & (i <= c) & (c <= j) & (j <= r))
                assert len(hit) == 1 and c[hit[0]] == i + int(np.argmin(h[i:j + 1] >> np.uint64(32)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op1_mixing", "op7_url_filter", "op9_pivot_topk"])
def test_query_equals_sql(spark, name):
    import duckdb
    from check import compare

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])[0] == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_runs(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert {"doc_id", "text", "full_epochs", "last_tokens"} <= set(got.columns) and got.count() > 0


def _roots(n, x, y):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(x, y):
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("sizes", [(12, 1, 40, 3), (90, 20)])
def test_passage_links_connect_what_all_pairs_connect(sizes):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    size = 2 * passages.LEAST + 1
    near = []
    for n in sizes:  # walks: neighbours agree, rows further apart do not, in mixed order
        rows = [rng.integers(0, 256, size, dtype=np.uint8)]
        while len(rows) < n:
            row = rows[rng.integers(max(len(rows) - 3, 0), len(rows))].copy()
            at = rng.integers(0, size - 5)
            row[at:at + rng.integers(3, 7)] = rng.integers(0, 256)
            rows.append(row)
        near += [rows[i] for i in rng.permutation(n)]
    g, n = np.repeat(np.arange(len(sizes)), sizes), sum(sizes)
    near, mask = np.array(near), np.ones((n, size), bool)
    cols = [pa.array(g), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(list(map(bytes, near)), pa.binary()),
            pa.array(list(map(bytes, np.packbits(mask, axis=1))), pa.binary())]
    batch = pa.RecordBatch.from_arrays(cols, ["g", "t", "place", "near", "mask"])
    got = pa.Table.from_batches(passages._link(iter([batch]))).to_pydict()
    x, y = np.triu_indices(n, 1)
    x, y = x[g[x] == g[y]], y[g[x] == g[y]]
    ok = passages.agree(near[x], mask[x], near[y], mask[y])
    want = _roots(n, x[ok], y[ok])
    assert len(sizes) < len(set(want)) + 2 < n  # neither all apart nor all one
    assert _roots(n, got["a"], got["b"]) == want


@pytest.mark.parametrize("words,edit", [(60, lambda p: p[:30] + ["x", "y"] + p[30:]), (60, lambda p: p[:28] + p[31:]),
                                        (100, lambda p: p[:33] + ["x", "y"] + p[33:66] + ["u", "v"] + p[66:])])
def test_passages_with_inserted_and_missing_words(spark, words, edit):
    rng = np.random.default_rng(5)

    def some(k):
        return [f"w{x}" for x in rng.integers(0, 10**6, k)]

    rows = []
    for i in range(20):
        p = some(words)
        rows += [(2 * i, " ".join(some(50) + p + some(50))), (2 * i + 1, " ".join(some(50) + edit(p) + some(50)))]
    got = {r.doc_id: r.class_id for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.get(2 * i) == got.get(2 * i + 1) == 2 * i for i in range(20)) >= 18
    assert all(c in (d, d - 1) for d, c in got.items())


def test_passages_met_by_their_left_side_are_not_compared_again(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, size = 300, 2 * passages.LEAST + 1
    left, right = rng.integers(0, 256, 8), rng.integers(0, 256, 8)
    near = np.repeat(rng.integers(0, 256, (n // 3, size), dtype=np.uint8), 3, axis=0)  # three alike each
    near[:, passages.LEAST + 1:passages.LEAST + 9] = right
    near[21:, passages.LEAST - 8:passages.LEAST] = left  # the others have left sides of their own
    near[0:21:3, passages.LEAST - 8:passages.LEAST - 4] += 1  # alike, and only the right side is the same
    mask = np.ones((n, size), bool)
    where = {}
    for i in range(n):
        where.setdefault((False, near[i, passages.LEAST - 8:passages.LEAST].tobytes()), []).append(i)
        where.setdefault((True, near[i, passages.LEAST + 1:passages.LEAST + 9].tobytes()), []).append(i)
    rows = [(k, i, again) for k, ((again, _), members) in enumerate(where.items()) for i in members]
    k, i, again = (np.array(c) for c in zip(*rows))
    cols = [pa.array(k), pa.array(i), pa.array(np.zeros(len(i), np.int64)), pa.array(list(map(bytes, near[i])), pa.binary()),
            pa.array(list(map(bytes, np.packbits(mask, axis=1)[i])), pa.binary()), pa.array(again)]
    compared, alike = [], passages._alike
    monkeypatch.setattr(passages, "_alike", lambda x, *y: compared.append(x.shape[1]) or alike(x, *y))
    names = ["g", "t", "place", "near", "mask", "again"]
    got = pa.Table.from_batches(passages._link(iter([pa.RecordBatch.from_arrays(cols, names)]))).to_pydict()
    assert sum(compared) < 0.8 * n * n  # both groups in full: n * (n - 1)
    pairs = [(a, b) for members in where.values() for a in members for b in members if a < b]
    x, y = (np.array(c) for c in zip(*pairs))
    ok = passages.agree(near[x], mask[x], near[y], mask[y])
    want = _roots(n, x[ok], y[ok])
    assert 1 < len(set(want)) < n
    assert _roots(n, got["a"], got["b"]) == want


@pytest.mark.parametrize("n", [0, 1, 500_000])
def test_filter_reaches_the_driver_as_bytes(spark, n):
    import tracemalloc

    from tripweave.llm.common import bloom_of, may_hold, probes

    keys = spark.range(n).select(F.xxhash64("id").alias("g"))
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")
    tracemalloc.start()
    try:
        got = bloom_of(keys, "g", 16)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, before)
    assert peak < 4 * got.nbytes + (1 << 20)  # not a row a word
    h = np.array([r.g for r in keys.collect()], np.int64).view(np.uint64)
    want = np.zeros(got.nbytes * 8, bool)
    for p in probes(h, len(want)):
        want[p.astype(np.int64)] = True
    assert (np.unpackbits(got.view(np.uint8), bitorder="little").view(bool) == want).all() and may_hold(got, h).all()
