"""WARC archives of gzip members: a writer, and a reader that splits files at any byte."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own, so that a repeated task writes the same bytes
PIECE = 1 << 18
RECORD = ("file string, offset bigint, record_id string, record_type string, target_uri string, payload_digest string, "
          "refers_to string, payload_bytes bigint, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def record(page_id, url: str | None, payload: bytes | None, size: int, sha: str, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + (payload or b"")
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {DATE}", "WARC-Target-URI: " + _uri(url), f"WARC-Payload-Digest: sha1:{sha}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with payload size, digest and the page they revisit: (page_id, url, size, sha, own, refers, payload).

    Of equal payloads the row with the smallest page_id (nulls last) is the response; of rows that repeat this page_id
    the one with the smallest url, of equal ones any.  The payload moves once, to the page that its digest names.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    same = ["sha", "size"]
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("count").alias("c"))
    owner = rows.groupBy(*same, "page_id").count().groupBy(*same).agg(F.min(order).alias("first"))
    owner = materialize(owner, "warc-owners")
    rows = rows.join(owner, same)
    first = F.col("page_id").eqNullSafe(F.col("first.p"))
    out = ["page_id", "url", "size", "sha", "own", "refers", F.when(F.col("own"), F.col("payload")).alias("payload")]
    plain = rows.where(~first | (F.col("first.c") == 1)).withColumns({"own": first, "refers": F.col("first.p")}).select(*out)
    if owner.where("first.c > 1").isEmpty():
        return plain
    again = rows.where(first & (F.col("first.c") > 1)).groupBy(*same, "page_id", "url").agg(F.count("*").alias("m"), F.min("payload").alias("payload"))
    low = again.groupBy(*same).agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("low"))
    again = again.join(low, same).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    own = (F.col("k") == 1) & F.col("url").eqNullSafe(F.col("low.url"))
    return plain.unionByName(again.withColumns({"own": own, "refers": F.col("page_id")}).select(*out))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns (file, bytes, records) of the archives.

    Each task writes one file under a name of its own try and then moves it to its final name, so that a repeated or
    doubled task leaves one whole archive.  Payloads are UTF-8; null counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = posixpath.join(base, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
        trial = f"{name}.{uuid.uuid4().hex}.tmp"
        n = size = 0
        with fs.open_output_stream(trial) as out:
            for b in batches:
                for page, url, length, sha, own, refers, payload in zip(*(b.column(k) for k in range(7))):
                    sha32 = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    refers_to = None if own.as_py() else ("none" if refers.as_py() is None else refers.as_py())
                    size += out.write(record(page.as_py(), url.as_py(), payload.as_py(), length.as_py(), sha32, refers_to))
                    n += 1
        fs.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([posixpath.basename(name)]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    return materialize(plan_records(pages).mapInArrow(run, "file string, bytes bigint, records bigint"), "warc-files")


class _Bytes:
    """A file read forward in pieces; what lies before ``at`` is given up."""

    def __init__(self, f, start: int):
        self.f, self.at, self.held = f, start, b""
        f.seek(start)

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.f.read(PIECE)
            if not more:
                return False
            self.held += more
        return True

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _member(src: _Bytes, offset: int) -> tuple[bytes, int] | None:
    """Content and length of the member ``offset`` bytes ahead, if it is a whole gzip member with a WARC record."""
    z, out, used, size = zlib.decompressobj(31), [], offset, 0
    try:
        while not z.eof:
            if used >= len(src.held) and not src.fill(used + 1):
                return None
            part = src.held[used:used + PIECE]
            out.append(z.decompress(part))
            used += len(part)
            size += len(out[-1])
            if size >= 5 and not b"".join(out[:3])[:5] == b"WARC/":
                return None
    except zlib.error:
        return None
    used -= len(z.unused_data)
    return b"".join(out), used - offset


def _fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def _parse(raw: bytes) -> tuple:
    warc, rest = _fields(raw)
    block = rest[:int(warc.get("content-length", 0))]
    kind = warc.get("warc-type", "")
    payload, size = block, len(block)
    if "application/http" in warc.get("content-type", ""):
        http, payload = _fields(block)
        size = int(http.get("content-length", len(payload))) if kind == "revisit" else len(payload)
    sha = digest(payload) if kind != "revisit" else warc.get("warc-payload-digest", "").removeprefix("sha1:")
    return (warc.get("warc-record-id"), kind, warc.get("warc-target-uri"), sha, warc.get("warc-refers-to"), size, None if kind == "revisit" else payload)


def records_in(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Records whose member starts in [start, end).

    The first start is found by its magic bytes; a candidate counts if it decodes with its checksum to a WARC record and is
    followed by another member's magic or the end of the file (which a member stored inside another one is not).  The
    next record starts where the last one ended.  A damaged member is passed over.
    """
    src = _Bytes(f, start)
    chained = start == 0
    while src.at < end:
        if not chained or not (src.fill(3) and src.held.startswith(MAGIC)):
            chained = False
            src.fill(3)
            k = src.held.find(MAGIC)
            if k < 0:  # the last two bytes may begin a magic
                src.skip(max(0, len(src.held) - 2))
                if not src.fill(3):
                    return
                continue
            src.skip(k)
            if src.at >= end:
                return
        got = _member(src, 0)
        if got is not None and not chained:
            more = src.fill(got[1] + 3)
            after = src.held[got[1]:got[1] + 3]
            if not (after == MAGIC or (not more and not after)):
                got = None
        if got is None:
            src.skip(1)
            chained = False
            continue
        yield src.at, got[0]
        src.skip(got[1])
        chained = True


def read(spark: SparkSession, folder: str, files: DataFrame, split: int = 1 << 22, with_payload: bool = False) -> DataFrame:
    """Records of the archives ``files`` (file, bytes) below ``folder``; each task scans a byte range of ``split`` bytes.

    A task owns the records that start inside its range.  payload_digest is computed anew from payloads that are there;
    revisits carry the digest and length of their head.  An empty table of files gives no records.
    """
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))).alias("start"))
    n = max(1, int(ranges.count()))
    ranges = ranges.repartition(min(n, 10_000), F.xxhash64("file", "start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
        for b in batches:
            for name, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows, held = [], 0
                with fs.open_input_file(posixpath.join(base, name)) as f:
                    for at, raw in records_in(f, start, min(size, start + split)):
                        row = (name, at, *_parse(raw))
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(raw) if with_payload else 500
                        if held > 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return ranges.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    file, offset.  A null page_id stays null, and so does refers_to a response without one."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = read(spark, folder, write(pages, folder))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page("refers_to").alias("refers_to"), "file", "offset")
