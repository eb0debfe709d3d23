"""WARC archives with a two-level capture index.

write_archives() writes one gzip member a record, so any record can be read by its byte range. write_index() sorts the
captures by reversed-host URL key (range partitions, so no task sorts more than its share), packs the sorted lines into
compressed blocks of BLOCK_LINES and keeps one directory row a block. Reading starts from the directory: lookup() finds
the index file and the block by binary search and then reads byte ranges only, find_records() does so for a table of URLs;
read_archives() walks all blocks.

Archives, index files and tables lie in one folder that all executors share. Files are written under a name of their
attempt and then moved to the name of their partition. Rows are totally ordered within a partition (id, URL, payload digest; equal
rows make equal records) and records hold nothing that differs between attempts, so a lost executor's task writes the same bytes again and ranges stay true.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import fresh_path, parts, saved, skewed_left_join

BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key with the host reversed: com,example,m)/path?query. Scheme, default ports and fragments don't count."""
    cut = urlsplit((url or "").strip().split("#")[0])
    host, _, port = cut.netloc.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (cut.path or "/") + (f"?{cut.query}" if cut.query else "")
    return quote(key, safe="".join(map(chr, range(33, 127))))


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, response: bool, first: object) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload but its length and digest."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '-', safe=''.join(map(chr, range(33, 127))))}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-Id: {quote(str(page), safe='')}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if response:
        block = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}"]
        if first is not None:
            head.append(f"X-Refers-To-Page-Id: {quote(str(first), safe='')}")
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record's gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


#: Schemes that Hadoop knows, and what pyarrow calls the same store. Fixed values.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def openable(folder: str) -> str:
    """The folder's address as pyarrow opens it; a store that it can't open, or a path without a scheme, is refused here,
    on the driver, before a task writes to its own disk."""
    scheme, colon, rest = folder.partition("://")
    if not colon or scheme not in SCHEMES:
        raise ValueError(f"archives can't be written to {folder}: name a folder in one of {', '.join(SCHEMES)}")
    return f"{SCHEMES[scheme]}://{rest}"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(openable(folder))


class _Part:
    """A file written under the attempt's name and moved into place when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _opened(folder)
        self.fs.create_dir(root)
        self.name, self.target, self.temp = name, f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.at = self.fs.open_output_stream(self.temp, compression=None), 0

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.target)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


CAPTURE = "page_id {id}, key string, file string, offset long, length long, record_type string"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _Part(folder, f"part-{_partition():06d}.warc.gz")
                out.add(gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(out.name, '')}\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0))
            rows = []
            ids, urls, payloads, firsts = (batch.column(i) for i in range(4))
            for page, url, payload, first, response in zip(ids.to_pylist(), urls.to_pylist(), payloads, firsts.to_pylist(), batch.column(4).to_pylist(), strict=True):
                data = payload.as_py() or b""
                raw = record(page, url, data, base64.b32encode(hashlib.sha1(data).digest()).decode(), response, first)
                rows.append((page, url_key(url), out.name, out.add(raw), len(raw), "response" if response else "revisit"))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), *(pa.array(c) for c in columns[1:])], names=["page_id", "key", "file", "offset", "length", "record_type"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, *, page: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 0) -> DataFrame:
    """Writes the archives; returns the captures (page_id, key, file, offset, length, record_type).

    Among records of equal payload of at least `least_revisit` bytes the smallest page id is a response, the others
    revisit it; rows that repeat that id are responses too. A row without an id is a response only where no equal
    payload has one. Null html is an empty payload, a null URL is written as "-". Other columns are ignored; an empty
    table writes no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{page}`").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    groups, _ = saved(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "payloads")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = skewed_left_join(rows, groups, "digest", "copies", total)
    response = (F.octet_length("payload") < least_revisit) | F.col("id").eqNullSafe(F.col("first"))
    ready = joined.select("id", "url", "payload", "first", response.alias("response"), "digest").sortWithinPartitions("id", "url", "digest")
    captures, _ = saved(ready.mapInArrow(_writer(folder), CAPTURE.format(id=rows.schema["id"].dataType.simpleString())), "captures")
    return captures


def _indexer(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, rows = None, [], []

        def flush() -> None:
            nonlocal out
            out = out or _Part(folder, f"index-{_partition():06d}.cdx.gz")
            raw = gzip.compress("".join(block).encode(), mtime=0)
            rows.append((block[0].split(" ", 1)[0], out.name, out.add(raw), len(raw), len(block)))
            block.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                block.append(f"{key} {'-' if page is None else quote(str(page), safe='')} {file} {offset} {length}\n")
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["first_key", "file", "offset", "length", "lines"])

    return run


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the compressed blocks of sorted lines; returns the directory (first_key, file, offset, length, lines)."""
    spark = captures.sparkSession
    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(parts(spark), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory, _ = saved(ordered.mapInArrow(_indexer(folder, lines), "first_key string, file string, offset long, length long, lines long"), "directory")
    return directory


class _Ranges:
    """Byte ranges of a folder's files; some files are kept open."""

    def __init__(self, folder: str):
        self.fs, self.root = _opened(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) > 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[file] = self.fs.open_input_file(f"{self.root}/{file}")
        return self.open[file].read_at(length, offset)

    def lines(self, file: str, offset: int, length: int) -> list[list[str]]:
        return [x.split(" ") for x in zlib.decompress(self.read(file, offset, length), 31).decode().splitlines()]


class _Blocks(_Ranges):
    """Index blocks, the last one kept, searched by key."""

    def __init__(self, folder: str):
        super().__init__(folder)
        self.now, self.kept, self.keys = None, [], []

    def found(self, block: tuple[str, int, int], key: str) -> list[list[str]]:
        if block != self.now:
            self.now, self.kept = block, self.lines(*block)
            self.keys = [x[0] for x in self.kept]
        return self.kept[bisect_left(self.keys, key) : bisect_right(self.keys, key)]


RECORD = "page_id string, key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _records(ranges: _Ranges, lines: list[list[str]]) -> pa.RecordBatch:
    """The records of index lines, read in the order of the files, so that ranges are read forwards."""
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows = []
    for key, _, warc, at, size in sorted(lines, key=lambda x: (x[2], int(x[3]))):
        head, payload = parsed(ranges.read(warc, int(at), int(size)))
        n, digest, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response":
            n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest:
                raise ValueError(f"{warc} at {at}: payload digest {found}, header {digest}")
        page, first = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        rows.append((page and unquote(page), key, head["WARC-Target-URI"], n, digest, kind, first and unquote(first)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for batch in batches:
            for block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _records(ranges, ranges.lines(*block))

    return run


#: Bytes of the directory that every task may hold; a larger one is walked instead.
DIRECTORY_BYTES = 64 << 20


def _placed(blocks_of):
    """(file, offset, length, key) of the blocks that can hold each key, by binary search of the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = blocks_of.value
        firsts = [b[0] for b in blocks]
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                rows += [(*b[1:], key) for b in blocks[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "offset", "length", "key"])

    return run


def _searched(folder: str):
    """The records of the asked keys; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder)
        lines: list[list[str]] = []
        for batch in batches:
            for file, offset, length, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lines and (file, offset, length) != blocks.now:
                    yield _records(blocks, lines)
                    lines = []
                lines += blocks.found((file, offset, length), key)
        if lines:
            yield _records(blocks, lines)

    return run


def find_records(directory: DataFrame, folder: str, urls: DataFrame, page_type: str = "long", directory_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """The records of all URLs in the first column of `urls`, each record once: page_id, key, url, payload_bytes, payload_digest,
    record_type, refers_to; ids are cast to `page_type`.

    Every task holds the sparse directory, if its size allows, and finds each key's blocks by binary search; a block's
    keys then meet in one task, which finds their lines by binary search and reads the records' ranges together. URLs that are repeated or
    have no record cost nothing more. With a directory beyond `directory_bytes` all blocks are walked and joined with the keys.
    """
    size = directory.agg(F.coalesce(F.sum(F.octet_length("first_key") + F.octet_length("file") + 64), F.lit(0))).first()[0]
    # each key once: a URL that many rows have is looked up once
    keys = urls.select(F.col(f"`{urls.columns[0]}`").alias("url")).mapInArrow(_keys, "key string").distinct()
    if size > directory_bytes:
        return read_archives(directory, folder, page_type).join(keys, "key", "left_semi").select(*(x.split()[0] for x in RECORD.split(", ")))
    blocks = sorted((r.first_key, r.file, r.offset, r.length) for r in directory.collect())
    shared = directory.sparkSession.sparkContext.broadcast(blocks)
    placed = keys.mapInArrow(_placed(shared), "file string, offset long, length long, key string")
    dealt = placed.repartition(parts(directory.sparkSession), "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(_searched(folder), RECORD).withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])


def read_archives(directory: DataFrame, folder: str, page_type: str = "long") -> DataFrame:
    """Every record, found through the index: blocks are dealt over the tasks, their lines give the records' ranges.

    page_id, key, url, payload_bytes, payload_digest, record_type, refers_to; ids are cast to `page_type`.
    """
    n = parts(directory.sparkSession)
    dealt = directory.select("file", "offset", "length").repartition(n, F.xxhash64("file", "offset"))
    return dealt.mapInArrow(_reader(folder), RECORD).withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


@dataclass
class Found:
    headers: dict[str, str]
    payload: bytes


def lookup(directory: DataFrame, folder: str, url: str) -> list[Found]:
    """The records of a URL: binary search over the index files, over one file's blocks and over a block's lines.

    The driver holds one row for each index file and then the directory of the files that can hold the key.
    """
    key, ranges, out = url_key(url), _Ranges(folder), []
    files = sorted((r.k, r.file) for r in directory.groupBy("file").agg(F.min("first_key").alias("k")).collect())
    firsts = [k for k, _ in files]
    near = [f for _, f in files[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]]
    blocks = sorted((r.first_key, r.file, r.offset, r.length) for r in directory.filter(F.col("file").isin(near)).collect())
    firsts = [b[0] for b in blocks]
    for _, file, offset, length in blocks[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
        lines = ranges.lines(file, offset, length)
        keys = [x[0] for x in lines]
        for _, _, warc, at, size in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
            out.append(Found(*parsed(ranges.read(warc, int(at), int(size)))))
    return out


def archived(spark: SparkSession, pages: DataFrame, **columns: str) -> tuple[DataFrame, str]:
    """Writes archives and index into a new shared folder; returns the directory and the folder."""
    folder = fresh_path(spark, "warc")
    openable(folder)
    return write_index(write_archives(pages, folder, **columns), folder), folder
