"""WARC archives with a two-level capture index.

Writing: each task writes gzip-per-record WARC/1.1 files into the shared folder and returns
where each record lies. Payloads are compared by SHA-1: of equal ones, the smallest page_id
is the response and the others are revisit records that refer to it.

Index: captures are sorted by reversed-host URL key (and page_id) into ranges, a file each, cut
into compressed blocks of BLOCK_LINES lines. The directory is sparse and apart from the blocks:
first and last key, offset and length of each block, and one key for each range. A lookup finds
its range by binary search in the range keys and its blocks by binary search in the range's
directory; only those blocks are read, by offset and length. The line comes from a binary search
in the decompressed block; then the record is read from the archive by offset and length too.

Files carry the attempt in their names, and only files that a finished task returned are
listed, so a repeated task leaves no half-written file in the index.

Defined cases: a null html is an empty payload; a null url has the key ")"; rows that repeat
page_id and payload are records of the same type; null page_ids are allowed and revisit any
page with an id; of equal payloads the smallest page_id is the response; a very long html is one
record, held whole in one task; an empty table gives no files and an empty index. Other columns
of pages, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_folder, read, skew_join, stored

BLOCK_LINES = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: Up to so many payloads that repeat (20 bytes and a page_id each) are broadcast to tell revisits.
BROADCAST_DIGESTS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, file string, at long, size long"
DIRECTORY = "shard int, block int, first_key string, last_key string, n int, file string, at long, size long"


def filesystem(uri: str):
    """The file system of a folder that all executors reach, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """http://www.Example.com:80/a b?c -> com,example,www:80)/a%20b?c"""
    rest = re.sub(r"^[^:/?#]*://", "", url or "", count=1)
    m = re.match(r"[^/?#]*", rest)
    host, path = m[0].lower().rpartition("@")[2], rest[m.end() :]
    name, colon, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + colon + port + ")" + path.partition("#")[0]
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", key)


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL key, then page_id (shifted so that it sorts as text; null first)."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """A response, or (without its payload of size bytes) a revisit of the page first, as one
    gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parsed(member: bytes) -> tuple[int | None, str, int | None, str, int, bytes | None]:
    """(page_id, type, refers_to, digest, payload length, payload or None) of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(field["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record cut short")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload doesn't fit its digest")
    return number(field["warc-record-id"]), kind, number(field["warc-refers-to"]) if "warc-refers-to" in field else None, digest, length, payload if kind == "response" else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = _Output(folder, "warc.gz")
    for batch in batches:
        rows = []
        columns = [batch.column(i) for i in range(6)]
        columns[2] = columns[2].cast(pa.binary())
        for page, url, payload, size, digest, first in zip(*[c.to_pylist() for c in columns], strict=True):
            member = record(page, url, payload, size, base64.b32encode(digest).decode(), first)
            at = out.write(member)
            rows.append((capture_key(url, page), out.name, at, len(member)))
            if out.at >= FILE_BYTES:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "at", "size"])
    out.close()


def write_archive(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) and returns their captures (key, file, at, size),
    already stored. Payloads of fewer than revisit_from bytes are always responses.

    html is read twice, to be hashed and to be written; a revisit takes its length and digest only."""
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    seen = stored(base.select("page_id", "url", "bytes", "digest"), "payloads")
    able = seen.filter(F.col("bytes") >= revisit_from)
    # One row for each payload from each task; then only what repeats goes on.
    first = stored(able.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"), "repeated")
    again = skew_join(able, first, ["digest"], "n", ["page_id", "url"]).filter("page_id IS NULL OR page_id <> first")
    again = stored(again.select("page_id", "url", "bytes", "digest", "first"), "revisits")
    rows = responses(base, first, again).withColumn("first", F.lit(None).cast("long")).unionByName(again, allowMissingColumns=True)
    rows = rows.select("page_id", "url", "payload", "bytes", "digest", "first")
    captures = stored(rows.mapInArrow(lambda it: _written(it, folder), CAPTURES), "captures")
    discard(seen, first, again)
    return captures


def responses(base: DataFrame, first: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of base (page_id, url, payload, bytes, digest) that are no revisits, by the stored
    payloads that repeat (digest, first) and their revisits (page_id, url, digest).

    Up to BROADCAST_DIGESTS such payloads are broadcast, and html stays where it was read. Beyond
    that, rows meet the revisits in a shuffle by page_id, url and digest, where a payload with
    very many pages has as many keys."""
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        met = base.join(F.broadcast(first.select("digest", "first")), "digest", "left")
        return met.filter("first IS NULL OR page_id <=> first").select(*base.columns)
    gone = again.select(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("digest").alias("_digest")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("digest") == F.col("_digest"))
    return base.join(gone, same, "left_anti")


class _Output:
    """A file of the shared folder that begins with its first write."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.out, self.name, self.at = folder, suffix, None, "", 0

    def write(self, raw: bytes) -> int:
        """Where raw begins."""
        if self.out is None:
            files, path = filesystem(self.folder)
            files.create_dir(path, recursive=True)
            self.name, self.at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.suffix}", 0
            self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.out.write(raw)
        self.at += len(raw)
        return self.at - len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _blocks(batches: Iterator[pa.RecordBatch], lines_each: int, folder: str) -> Iterator[pa.RecordBatch]:
    shard, out = TaskContext.get().partitionId(), _Output(folder, "cdx.z")
    lines: list[str] = []
    number = 0

    def block() -> pa.RecordBatch:
        nonlocal number
        raw = zlib.compress("\n".join(lines).encode())
        at = out.write(raw)
        row = [[shard], [number], [lines[0].partition("\t")[0]], [lines[-1].partition("\t")[0]], [len(lines)], [f"{folder}/{out.name}"], [at], [len(raw)]]
        number += 1
        lines.clear()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in DIRECTORY.split(", ")])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            lines.append("\t".join(map(str, row)))
            if len(lines) == lines_each:
                yield block()
    if lines:
        last = block()
        out.close()
        yield last
    out.close()


def build_index(captures: DataFrame, lines_each: int = BLOCK_LINES) -> DataFrame:
    """Writes the compressed blocks into files of a new shared folder and returns the stored
    directory (DIRECTORY), one row for each block. Ranges end between any two captures, also those
    of one URL, so a URL with very many captures has many blocks."""
    spark = captures.sparkSession
    parts, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), new_folder(spark, "index-blocks")
    ordered = captures.select("key", "file", "at", "size").repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return stored(ordered.mapInArrow(lambda it: _blocks(it, lines_each, folder), DIRECTORY), "index")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, key, last_key, file, at, size, asks), a range's directory (kind 0) before
    the keys asked of it: key, asks and place of each block that may hold the key."""
    shard, first, last, place = None, [], [], []
    for batch in batches:
        found = []
        for s, kind, key, until, file, at, size, asks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if s != shard:
                shard, first, last, place = s, [], [], []
            if kind == 0:
                first.append(key)
                last.append(until)
                place.append((file, at, size))
                continue
            for b in range(max(0, bisect.bisect_left(first, key) - 1), bisect.bisect_right(first, key)):
                if last[b] >= key:
                    found.append((key, asks, *place[b]))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["key", "asks", "file", "at", "size"])


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, asks, file, at, size) sorted by file and place: the captures of the keys."""
    name, handle, opened, keys, lines = None, None, None, [], []
    for batch in batches:
        found = []
        for key, asks, file, at, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if file != name:
                if handle is not None:
                    handle.close()
                files, path = filesystem(file)
                name, handle, opened = file, files.open_input_file(path), None
            if at != opened:
                lines = zlib.decompress(handle.read_at(size, at)).decode().split("\n")
                opened, keys = at, [x.partition("\t")[0] for x in lines]
            for k in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                _, record_file, begin, length = lines[k].split("\t")
                found += [(key, record_file, int(begin), int(length))] * asks
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["key", "file", "at", "size"])
    if handle is not None:
        handle.close()


def blocks_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, asks, file, at, size): the blocks that may hold the keys in wanted (key), and how
    many rows of wanted ask for each. Keys that lie in no block have no row."""
    # As many rows as there are ranges.
    ranges = sorted((r["low"], r["high"], r["shard"]) for r in index.groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    lows = [r[0] for r in ranges]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, asks, shards = [], [], []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # Captures of one key may begin in a range before.
                for k in range(max(0, bisect.bisect_left(lows, key) - 1), bisect.bisect_right(lows, key)):
                    if ranges[k][1] >= key:
                        keys.append(key)
                        asks.append(n)
                        shards.append(ranges[k][2])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(asks, pa.int64()), pa.array(shards, pa.int32())], names=["key", "asks", "shard"])

    asked = wanted.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("asks")).mapInArrow(placed, "key string, asks long, shard int")
    directory = index.select("shard", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "file", "at", "size")
    both = directory.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "shard").sortWithinPartitions("shard", "kind", "key", "file", "at")
    return both.select("shard", "kind", "key", "last_key", "file", "at", "size", "asks").mapInArrow(_searched, "key string, asks long, file string, at long, size long")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures (key, file, at, size) of the keys in wanted (key); each capture once for each
    row that asks for it. Keys that the index lacks give nothing. A block is read once."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks_of(index, wanted).repartition(parts, "file").sortWithinPartitions("file", "at", "key")
    return ordered.mapInArrow(_read_blocks, CAPTURES)


def _fetched(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    files, path = filesystem(folder)
    name, handle, size_all, begin, held = None, None, 0, 0, b""
    for batch in batches:
        out = []
        for _, file, at, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if file != name:
                if handle is not None:
                    handle.close()
                name, handle, begin, held = file, files.open_input_file(f"{path}/{file}"), 0, b""
                size_all = handle.size()
            if not begin <= at <= at + size <= begin + len(held):  # neighbours come in one read
                begin, held = at, handle.read_at(min(max(size, READ_BYTES), size_all - at), at)
            out.append(parsed(held[at - begin : at - begin + size]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        yield pa.RecordBatch.from_arrays(columns[: 6 if with_payload else 5], names=names[: 6 if with_payload else 5])
    if handle is not None:
        handle.close()


def fetch(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of captures, read by range; every file is read by one task, in order."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * with_payload
    ordered = captures.select("key", "file", "at", "size").repartition(parts, "file").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(lambda it: _fetched(it, folder, with_payload), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    index = build_index(write_archive(pages, folder))
    asked = pages.select("page_id", "url").distinct()
    wanted = asked.mapInArrow(_keys, "key string")
    out = fetch(lookup(index, wanted), folder, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])


OP3_SQL = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT)::INT % 32 + 1, 1)), '') AS digest FROM h),
f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (digest)
"""
