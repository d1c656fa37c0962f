"""WARC archives with a two-level capture index.

Records are gzip members of archive files in the shared folder. Their captures, sorted by reversed-host key, lie in compressed
blocks; a sparse directory has the first key of each block. A look-up searches the directory, reads one block's range, searches
that, and reads the record's range. Files appear under names of their task attempt; only those that a committed manifest
names count, so lost executors and repeated tasks leave no wrong records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import scratch, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def sort_key(url: str | None) -> str:
    """The reversed-host key: ``http://www.a.com:80/x?y`` to ``com,a,www:80)/x?y``. Text that isn't such a URL is its own key; null: empty."""
    clean = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname, parts.port
    except ValueError:
        return clean
    if not host:
        return clean
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 response record, or a revisit record of the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}" if url is not None else "", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>" if revisit else "",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one uncompressed record; raises where the payload doesn't have the digest that the record states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "digest": digest, "size": size, "payload": payload}


@dataclass
class Archive:
    """Where an archive's files, index blocks and block directory lie."""

    spark: SparkSession
    root: str

    def directory_file(self) -> str:
        return f"{self.root}/directory.z"


class _Files:
    """Readers of one task, opened once a file."""

    def __init__(self) -> None:
        self.open: dict[str, pa.NativeFile] = {}

    def range(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) > 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self.open[uri] = fs.open_input_file(path)
        return self.open[uri].read_at(length, offset)


class _Part:
    """A file of this task attempt, written beside its final name and moved there when it is whole."""

    def __init__(self, root: str, kind: str, roll: int = 0) -> None:
        task = TaskContext.get()
        self.name = f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{roll}"
        self.uri = f"{root}/{self.name}"
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(f"{self.path}.tmp"), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(f"{self.path}.tmp", self.path)


def write_archive(pages: DataFrame, min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30, block_lines: int = 3000, max_blocks: int = 200_000) -> Archive:
    """A record for each row of ``pages(page_id, url, html, ...)``, and the index.

    Payload: ``html`` in UTF-8 (null: empty). Of equal payloads of ``min_revisit`` bytes or more, the smallest page_id is a
    response (each row of it, where rows repeat) and others revisit it; null ids come last. Null URLs have the empty key. Blocks
    have ``block_lines`` captures, or more where the directory would have over ``max_blocks`` entries.
    """
    spark, root = pages.sparkSession, scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", html.alias("payload")).withColumn("hex", F.sha1("payload"))
    least = own.groupBy("hex").agg(F.min("page_id").alias("least"))
    revisit = (F.octet_length("payload") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("least"))
    records = own.join(least, "hex").select("page_id", "url", "payload", "hex", F.col("least").alias("refers_to"), revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rolled = None, 0
        for batch in batches:
            rows = []
            # a few payloads at a time are Python objects beside the batch
            few = (batch.slice(k, 64) for k in range(0, batch.num_rows, 64))
            for page_id, url, payload, digest, refers_to, again in chain.from_iterable(zip(*(c.to_pylist() for c in x.columns)) for x in few):
                if part is None or part.at >= file_bytes:
                    if part:
                        part.close()
                    part, rolled = _Part(root, "warc", rolled), rolled + 1
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, again, date)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                offset, length = part.add(squeeze.compress(raw) + squeeze.flush())
                rows.append((sort_key(url), page_id, part.name, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "at", "length"])
        if part:
            part.close()

    captures = written(records.mapInArrow(write, "key string, page_id long, file string, at long, length long"), "warc-manifest")
    per_block = max(block_lines, -(-captures.count() // max_blocks))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, rows = None, [], []

        def flush(some: list) -> None:
            text = "".join(f"{k}\t{'' if p is None else p}\t{f}\t{a}\t{n}\n" for k, p, f, a, n in some)
            rows.append((some[0][0], some[0][1], part.name, *part.add(zlib.compress(text.encode(), 6))))

        for batch in batches:
            part = part or _Part(root, "index")
            waiting += zip(*(c.to_pylist() for c in batch.columns))
            while len(waiting) >= per_block:
                flush(waiting[:per_block])
                waiting = waiting[per_block:]
        if part:
            if waiting:
                flush(waiting)
            part.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "at", "length"])

    line = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    directory = written(line.mapInArrow(blocks, "key string, page_id long, file string, at long, length long"), "warc-directory")
    # at most max_blocks rows and one a partition
    rows = sorted(directory.collect(), key=lambda r: _order(r.key, r.page_id))
    text = "".join(f"{r.key}\t{'' if r.page_id is None else r.page_id}\t{r.file}\t{r['at']}\t{r.length}\n" for r in rows)
    archive = Archive(spark, root)
    fs, path = pafs.FileSystem.from_uri(archive.directory_file())
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(zlib.compress(text.encode(), 6))
    return archive


def _order(key: str, page_id: int | None) -> tuple[str, bool, int]:
    return key, page_id is not None, page_id or 0


def _lines(data: bytes) -> list[tuple[tuple[str, bool, int], str, int, int]]:
    out = []
    for x in zlib.decompress(data).decode().split("\n")[:-1]:
        key, page_id, file, at, length = x.split("\t")
        out.append((_order(key, int(page_id) if page_id else None), file, int(at), int(length)))
    return out


def find(root: str, directory: list, wanted: tuple[str, bool, int], files: _Files, cache: dict) -> Iterator[tuple[str, int, int]]:
    """``(file, offset, length)`` of the captures of one key: binary search in the directory, then in the blocks that may hold it."""
    at = max(0, bisect.bisect_left(directory, wanted, key=lambda x: x[0]) - 1)
    while at < len(directory) and directory[at][0] <= wanted:
        if at not in cache:
            if len(cache) >= 4:
                cache.pop(next(iter(cache)))
            _, file, offset, length = directory[at]
            cache[at] = _lines(files.range(f"{root}/{file}", offset, length))
        block = cache[at]
        k = bisect.bisect_left(block, wanted, key=lambda x: x[0])
        while k < len(block) and block[k][0] == wanted:
            yield block[k][1:]
            k += 1
        at += 1


def look_up(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted(url, page_id)``, each once: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``.

    Keys are sorted first, so that tasks read neighbouring blocks. Pairs that the archive doesn't have give no row.
    """
    root, where = archive.root, archive.directory_file()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sort_key(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["key", "page_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, cache, directory = _Files(), {}, None
        for batch in batches:
            if directory is None:
                fs, path = pafs.FileSystem.from_uri(where)
                with fs.open_input_stream(path) as f:
                    directory = _lines(f.read())
            rows = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                for file, offset, length in find(root, directory, _order(key, page_id), files, cache):
                    x = parse_record(zlib.decompress(files.range(f"{root}/{file}", offset, length), 31))
                    rows.append((x["page_id"], x["url"], x["size"], x["digest"], x["type"], x["refers_to"]))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    keys = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keyed, "key string, page_id long").distinct()
    # the keys are small, the records they stand for aren't: a fixed number of parts keeps Spark from putting them together
    parts = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    line = keys.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return line.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_members(data: bytes) -> Iterator[dict]:
    """All records of an archive file's bytes, one after the other, as a reader without an index sees them."""
    stream = io.BytesIO(data).getvalue()
    while stream:
        one = zlib.decompressobj(31)
        raw = one.decompress(stream)
        stream = one.unused_data
        yield parse_record(raw)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as an archive and looked up again by URL and id."""
    return look_up(write_archive(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
