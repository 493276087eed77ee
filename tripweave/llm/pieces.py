"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

A text is normalised by the longest prefix at each place that the model's compiled character map lists, with the source
byte of every normalised byte beside it.  The normalised text is cut before each run of space symbols, which no piece of
the model crosses, so the parts merge independently: equal parts are merged once per task, by the library's merge rules, and
looked up after that.  The pieces' lengths and the alignment then give each piece's bytes in the source.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.common import q

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BPE, CONTROL, UNKNOWN, BYTE = 2, 3, 2, 6  # model type; types of pieces
CACHE, CACHED_LENGTH = 200_000, 100  # parts that a task remembers, and their longest
STRETCH = 1 << 20  # characters of texts that are looked up at a time


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + n]
            at += n


def trie_keys(units: np.ndarray) -> dict[bytes, int]:
    """All keys of a double-array trie with their values; each step follows all live nodes over all bytes at once."""
    low31, low8 = np.uint32((1 << 31) - 1), np.uint32(0x800000FF)
    jump = lambda u: (u >> np.uint32(10)) << ((u & np.uint32(1 << 9)) >> np.uint32(6))
    node, keys, out = jump(units[:1]), [b""], {}
    while len(node):
        at = (node[:, None] ^ np.arange(1, 256, dtype=np.uint32)).ravel()
        inside = at < len(units)
        unit = units[np.where(inside, at, 0)]
        hit = np.flatnonzero(inside & (unit & low8 == np.tile(np.arange(1, 256, dtype=np.uint32), len(node))))
        keys = [keys[k // 255] + bytes([k % 255 + 1]) for k in hit.tolist()]
        unit, node = unit[hit], at[hit] ^ jump(unit[hit])
        for k in np.flatnonzero(unit >> np.uint32(8) & np.uint32(1)).tolist():
            out[keys[k]] = int(units[node[k]] & low31)
    return out


class Normaliser:
    """The rules of a model's normaliser: character map, space symbol, and what happens to extra spaces."""

    def __init__(self, spec: bytes):
        fields = dict(wire(spec))
        self.prefix, self.trim, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))
        charmap = fields.get(2, b"")
        self.map: dict[str, bytes] = {}
        if charmap:
            n = 4 + int.from_bytes(charmap[:4], "little")
            strings = charmap[n:]
            for key, at in trie_keys(np.frombuffer(charmap[4:n], "<u4")).items():
                self.map[key.decode()] = strings[at:strings.index(b"\0", at)]
        if any(b"  " in v for v in self.map.values()):
            raise ValueError("a replacement with two spaces in a row is not supported")
        lengths: dict[str, set[int]] = {}
        for key in self.map:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.first = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.map else None

    def mapped(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text after the character map, and how many of its bytes each source byte has: a replaced prefix counts at its first."""
        if not self.first or not self.first.search(text):
            data = text.encode()
            return data, np.ones(len(data), np.int32)
        out, sizes, at = [], [], 0
        while at < len(text):
            hit = self.first.search(text, at)
            end = hit.start() if hit else len(text)
            if end > at:
                out.append(text[at:end].encode())
                sizes += [1] * len(out[-1])
            if not hit:
                break
            key = next((text[end:end + n] for n in self.lengths[text[end]] if text[end:end + n] in self.map), None)
            new = text[end].encode() if key is None else self.map[key]
            source = len((key or text[end]).encode())
            out.append(new)
            sizes += [1] * source if key is None else [len(new)] + [0] * (source - 1)
            at = end + len(key or text[end])
        return b"".join(out), np.array(sizes, np.int32)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the source byte of each of its bytes, with one more entry for its end."""
        data, sizes = self.mapped(text)
        source = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        codes = np.frombuffer(data, np.uint8)
        if self.trim:
            blank = codes == 32
            keep = ~blank
            keep[1:] |= ~blank[:-1]  # the first space of a run stays, but for the start of the text
            codes, source = codes[keep], source[keep]
            if not (~blank).any():
                return "", np.zeros(1, np.int32)
        if not len(codes):
            return "", np.zeros(1, np.int32)
        text = codes.tobytes().decode()
        if self.escape:
            source = np.repeat(source, 1 + 2 * (codes == 32))
            text = text.replace(" ", SPACE)
        mark = SPACE if self.escape else " "
        if self.prefix:
            text, source = mark + text, np.concatenate([np.repeat(source[:1], len(mark.encode())), source])
        source = np.append(source, np.int32(len(sizes)))
        if self.trim:
            text = text.rstrip(mark)
            source = source[:len(text.encode()) + 1]
        return text, source


class Model:
    """Vocabulary and rules of a BPE model with byte fallback, read from its bytes."""

    def __init__(self, data: bytes):
        import sentencepiece

        fields = list(wire(data))
        trainer, spec = (b"".join(v for k, v in fields if k == n) for n in (2, 3))
        rules = dict(wire(trainer))
        pieces = [dict(wire(v)) for k, v in fields if k == 1]
        self.names = [p[1].decode() for p in pieces]
        self.types = np.array([p.get(3, 1) for p in pieces])
        if rules.get(3, 1) != BPE or not rules.get(35) or rules.get(24):
            raise ValueError("only BPE models with byte fallback and the space symbol in front are supported")
        self.normalise = Normaliser(spec)
        self.unknown = rules.get(44, " ⁇ ".encode())
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.names) or not self.normalise.escape
        # the same vocabulary without a normaliser: the last value of a field holds, so an empty map and no prefix are appended
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=data + bytes([26, 8, 18, 0, 24, 0, 32, 0, 40, 0]))
        self.sizes = [len(p.encode()) for p in self.names]
        self.bytes = {k: int(self.names[k][3:5], 16) for k in np.flatnonzero(self.types == BYTE).tolist()}
        self.parts: dict[str, tuple[int, ...]] = {}

    def packed(self, ids: list[int]) -> tuple[int, ...]:
        """Ids with their pieces' normalised bytes in the upper half; of a character in bytes, the last one has them all."""
        out, left, size = [], 0, 0
        for k in ids:
            n = self.sizes[k]
            if k in self.bytes:
                if not left:
                    b = self.bytes[k]
                    left = size = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                left -= 1
                n = 0 if left else size
            out.append(k | n << 32)
        return tuple(out)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first bytes and end bytes of the pieces of each text."""
        done = [self.normalise(t) for t in texts]
        cut = [([t] if t else []) if self.crosses else PART.findall(t) for t, _ in done]
        if len(self.parts) > CACHE:
            self.parts.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.parts))
        found = dict(zip(new, map(self.packed, self.merge.encode(new)))) if new else {}
        self.parts.update({k: v for k, v in found.items() if len(k) <= CACHED_LENGTH})
        at = {**self.parts, **found} if any(len(k) > CACHED_LENGTH for k in found) else self.parts
        for parts, (_, source) in zip(cut, done):
            both = np.fromiter(chain.from_iterable(map(at.__getitem__, parts)), np.int64)
            ends = np.cumsum(both >> 32)
            yield (both & 0xFFFFFFFF).astype(np.int32), source[ends - (both >> 32)], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids; each byte that is no part of a character becomes U+FFFD."""
        out = self.surfaces()[ids].tolist()
        if self.normalise.prefix or self.normalise.trim:
            for j, k in enumerate(ids.tolist()):
                if self.types[k] in (UNKNOWN, BYTE):
                    break
                if self.types[k] == CONTROL:
                    continue
                if self.names[k].startswith(SPACE):
                    out[j] = out[j][1:]
                if out[j] or not self.normalise.trim:
                    break
        cuts = [0, *np.flatnonzero(self.types[ids] == CONTROL).tolist(), len(out)]  # bytes on both sides of one are no character
        return "".join(b"".join(out[a:b]).decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:]))

    @lru_cache(maxsize=1)  # noqa: B019
    def surfaces(self) -> np.ndarray:
        out = np.empty(len(self.names), object)
        for k, name in enumerate(self.names):
            kind = self.types[k]
            out[k] = (b"" if kind == CONTROL else self.unknown if kind == UNKNOWN else bytes([self.bytes[k]]) if kind == BYTE
                      else name.replace(SPACE, " ").encode())
        return out


codecs.register_error("each_byte", lambda ex: ("�" * (ex.end - ex.start), ex.end))


@lru_cache(maxsize=4)
def load(data: bytes) -> Model:
    return Model(data)


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver and sent with the tasks, so that executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def _stretches(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in order, about STRETCH characters at a time, or one longer text; a null is an empty text."""
    some, size = [], 0
    for x in column:
        text = x.as_py() or ""
        if some and size + len(text) > STRETCH:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, model: bytes, decoded: bool = False) -> DataFrame:
    """(doc_id, n_bytes, ids, begins, ends) of every text: piece i stands for the source bytes begins[i] to ends[i].

    With ``decoded`` the text that the ids decode to comes along, from the same pass.  A piece that stands for no byte of the
    source (the space put in front, all but the last byte of a character in bytes) has begin = end.  Null and empty texts
    have empty lists; repeated rows and null ids are kept; a very long text is one row like any other; an empty table has no
    rows; columns besides doc_id and text are not read.  Rows leave a task a stretch of texts at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            at = 0
            for texts in _stretches(b.column(1)):
                got = list(m.encode(texts))
                cols = [b.column(0).slice(at, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()), *[_lists([x[k] for x in got]) for k in range(3)]]
                cols += [pa.array([m.decode(x[0]) for x in got], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "ids", "begins", "ends", "decoded"][:len(cols)])
                at += len(texts)

    kind = docs.select(q("doc_id")).dtypes[0][1]
    return docs.select(q("doc_id").alias("doc_id"), q("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """The rows with a column ``decoded`` more, the text of their ``ids``; a null list gives an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            ids = b.column("ids")
            texts = [m.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    schema = encoded.select("*", F.lit("").alias("decoded")).schema
    return encoded.mapInArrow(run, schema)
