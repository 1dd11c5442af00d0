"""WARC archives with a two-level capture index.

**Archives.** Pages become WARC/1.1 records, each a gzip member of its own, in one file for each task. Of
records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is a response and
the others are revisits that refer to it; they repeat the HTTP header, whose Content-Length is that of the
full payload, but not the payload.

**Index.** Captures are range-partitioned and sorted by the URL key, which has the host's labels reversed
(``com,example)/path``), then page_id. Each index file is a series of compressed blocks of ``LINES`` lines
and ends with a sparse directory of the blocks: first key, offset, length. A lookup bisects the files' first
keys, then one file's directory, reads and unpacks one block by range, bisects its lines and has the place
of the record. Lookups of many pages run in key order, so that a block is read once, and the records found
are read by ascending ranges, neighbours in one read.

Files are named after the task attempt and count only if the staged manifest names them. They are written
with pyarrow's filesystems, so the shared folder may be local, HDFS or an object store.

Defined cases: a null html is an empty payload; a null url is the empty URL; a URL that can't be parsed is
its own key; rows that repeat a page_id are records of their own, and all with the largest page_id of their
payload are responses; a null page_id revisits any other, and is a response if its payload has no page_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import new_path, small_batches, stage

REVISIT_BYTES = 1000
LINES = 512
READ_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"LWCDXIDX"


def url_key(url: str) -> str:
    """The URL with its host's labels reversed: no scheme, user, default port or fragment; the host in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def record_id(page_id: int | None, capture: str = "") -> str:
    """A version 8 UUID that spells out the page_id; the first bit tells a null, the next 31 are a hash of the capture
    (its URL and payload digest), so that rows that repeat a page_id have ids of their own."""
    number, head = (page_id or 0) & ((1 << 64) - 1), (page_id is not None) << 31 | zlib.crc32(capture.encode()) >> 1
    return f"{head:08x}-0000-8{number >> 60:03x}-8{number >> 48 & 0xFFF:03x}-{number & (1 << 48) - 1:012x}"


def page_of(record: str) -> int | None:
    head, _, top, middle, low = record.split("-")
    if not int(head, 16) >> 31:
        return None
    number = int(top[1:], 16) << 60 | int(middle[1:], 16) << 48 | int(low, 16)
    return number - (1 << 64) if number >> 63 else number


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, target: int | None, target_url: str | None = None) -> bytes:
    """A record, not compressed; ``target`` (the page_id, and its URL) makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if target is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, url + digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if target is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(target, (target_url or '') + digest)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """What a record says, with the digest of a response's payload computed anew and held against its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": page_of(headers["WARC-Record-ID"][10:-1]), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = page_of(headers["WARC-Refers-To"][10:-1])
    elif hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return out


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _attempt_file(folder: str, kind: str):
    context = TaskContext.get()
    name = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return name, store.open_output_stream(f"{base}/{name}")


def _write_archive(folder: str):
    names = ["key", "page_id", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, digest, target, target_url in zip(*[batch.column(k) for k in range(6)], strict=True):
                if out is None:
                    name, out = _attempt_file(folder, "pages.warc.gz")
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{name}')}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    at = out.write(_gzip(info.encode()))
                url = url.as_py() or ""
                page_id = page_id.as_py()
                packed = _gzip(build_record(page_id, url, (html.as_py() or "").encode(), digest.as_py(), target.as_py(), target_url.as_py()))
                out.write(packed)
                rows.append((url_key(url), page_id, name, at, len(packed)))
                at += len(packed)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return run


def _pages_with_targets(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, target, target_url``; the payloads themselves are shuffled by page_id at most."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    narrow = stage(pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "warc-digests")
    groups = narrow.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
    shared = groups.where((F.col("n") > 1) & F.col("top.page_id").isNotNull()).select("digest", F.col("top.page_id").alias("target"), F.col("top.url").alias("target_url"))
    revisits = stage(
        narrow.where(F.col("bytes") >= REVISIT_BYTES).join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("target"))).select("page_id", "digest", "target", "target_url").distinct(),
        "warc-revisits",
    ).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "target", "target_url")
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    on = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    return rows.join(revisits, on, "left").select("page_id", "url", "html", "digest", "target", "target_url")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records; returns the staged captures: key, page_id, file, offset, length."""
    captures = _pages_with_targets(pages).mapInArrow(_write_archive(folder), "key string, page_id long, file string, offset long, length long")
    return stage(captures, "warc-captures")


def _sort_key(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """Spark's order of (key, page_id): bytes of the key, nulls first."""
    return key.encode(), page_id is not None, page_id or 0


def _write_index(folder: str, lines_a_block: int):
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("captures", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, lines, directory, total = None, None, 0, [], [], 0

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 3)
            directory.append([*lines[0][:2], at, len(packed)])
            out.write(packed)
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if out is None:
                    name, out = _attempt_file(folder, "index.cdx")
                lines.append(list(row))
                total += 1
                if len(lines) == lines_a_block:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), 3)
            out.write(packed + struct.pack("<qq8s", at, len(packed), _MAGIC))
            out.close()
            row = (TaskContext.get().partitionId(), name, *directory[0][:2], total)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def write_index(captures: DataFrame, folder: str, n_shards: int | None = None, lines_a_block: int = LINES) -> DataFrame:
    """Sort the captures into index files; returns the staged manifest, one row for each file."""
    if n_shards is None:
        n_shards = max(1, captures.count() // 200_000, captures.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("key").asc_nulls_first(), F.col("page_id").asc_nulls_first()]
    ordered = captures.repartitionByRange(int(n_shards), *order).sortWithinPartitions(*order, "file", "offset")
    manifest = ordered.mapInArrow(_write_index(folder, lines_a_block), "shard long, file string, first_key string, first_page long, captures long")
    return stage(manifest, "warc-manifest")


class CaptureIndex:
    """Lookups by key and page_id: files by their first keys, blocks by the directory, lines in the block."""

    def __init__(self, folder: str, manifest: list[tuple[str, str, int | None]]):
        self.folder = folder
        rows = sorted((_sort_key(key, page), file) for file, key, page in manifest)
        self.firsts, self.files = [k for k, _ in rows], [f for _, f in rows]
        self.at_file, self.at_block = (None, None, [], []), (None, [], [])

    def _file(self, k: int):
        if self.at_file[0] != k:
            self.close()
            store, base = fs.FileSystem.from_uri(self.folder)
            opened = store.open_input_file(f"{base}/{self.files[k]}")
            tail = struct.calcsize("<qq8s")
            at, length, magic = struct.unpack("<qq8s", opened.read_at(tail, opened.size() - tail))
            if magic != _MAGIC:
                raise ValueError("not an index file")
            directory = json.loads(zlib.decompress(opened.read_at(length, at)))
            self.at_file = (k, opened, directory, [_sort_key(*row[:2]) for row in directory])
        return self.at_file[1:]

    def close(self) -> None:
        if self.at_file[0] is not None:
            self.at_file[1].close()
            self.at_file, self.at_block = (None, None, [], []), (None, [], [])

    def _block(self, k: int, b: int):
        opened, directory, _ = self._file(k)
        if self.at_block[0] != (k, b):
            at, length = directory[b][2:]
            lines = [json.loads(line) for line in zlib.decompress(opened.read_at(length, at)).split(b"\n")]
            self.at_block = ((k, b), lines, [_sort_key(*line[:2]) for line in lines])
        return self.at_block[1:]

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of this key and page_id; equal ones may span blocks and files."""
        wanted, found = _sort_key(key, page_id), []
        k = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while k < len(self.files) and self.firsts[k] <= wanted:
            firsts = self._file(k)[2]
            b = max(0, bisect.bisect_left(firsts, wanted) - 1)
            while b < len(firsts) and firsts[b] <= wanted:
                lines, keys = self._block(k, b)
                for line in lines[bisect.bisect_left(keys, wanted) : bisect.bisect_right(keys, wanted)]:
                    found.append(tuple(line[2:]))
                b += 1
            k += 1
        return found


def _look_up(folder: str, manifest: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, manifest)
        for batch in batches:
            places = [place for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for place in index.find(key, page)]
            columns = list(zip(*places, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])
        index.close()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [url_key(url or "") for url in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(1)], names=["key", "page_id"])


def _read_records(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """Neighbouring records of a file as one range: file, begin, end, the records in it."""
        k = 0
        while k < len(rows):
            file, begin, length = rows[k]
            end, own = begin + length, [(begin, length)]
            while k + 1 < len(rows) and rows[k + 1][0] == file and rows[k + 1][1] <= end and rows[k + 1][1] + rows[k + 1][2] - begin <= READ_BYTES:
                k += 1
                own.append(rows[k][1:])
                end = max(end, rows[k][1] + rows[k][2])
            yield file, begin, end, own
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, opened = None, None
        for batch in batches:
            out = []
            for file, begin, end, own in ranges(list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))):
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, store.open_input_file(f"{base}/{file}")
                data = opened.read_at(end - begin, begin)
                out += [parse_record(zlib.decompress(data[at - begin : at - begin + length], 31)) for at, length in own]
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if opened is not None:
            opened.close()

    return run


def read_pages(keys: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """Look up ``keys`` (url, page_id) through the index and read their records: page_id, payload_bytes,
    payload_digest, record_type, refers_to. The manifest has a row for each index file of many captures."""
    files = [tuple(r) for r in manifest.select("file", "first_key", "first_page").collect()]
    order = [F.col("key").asc_nulls_first(), F.col("page_id").asc_nulls_first()]
    wanted = keys.select("url", "page_id").mapInArrow(_keys, "key string, page_id long").distinct()
    ordered = wanted.repartitionByRange(max(1, len(files)), *order).sortWithinPartitions(*order)
    places = ordered.mapInArrow(_look_up(folder, files), "file string, offset long, length long")
    # An explicit number: adaptive execution would join the tiny rows into one task, and each is a range read.
    by_file = places.repartition(max(1, len(files)), "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(_read_records(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index of ``pages``, then read every page back through the index."""
    small_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    folder = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    manifest = write_index(write_archives(pages, folder), folder)
    return read_pages(pages, folder, manifest)
