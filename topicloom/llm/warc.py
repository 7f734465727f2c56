"""WARC archives with a two-level index of their captures."""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.store import written
from topicloom.operators.skew import frequent_keys, partitions, salted_join
from topicloom.session import scratch_path

#: Bytes of the smallest payload that a revisit may stand for.
REVISIT_BYTES = 1000
#: Size of an archive file before the next one is begun, lines of an index block, gzip level.
ARCHIVE_BYTES = 1 << 28
BLOCK_LINES = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

CAPTURES = "key string, id long, file string, offset long, length long"
CAPTURE_SCHEMA = pa.schema(
    [
        ("key", pa.string()),
        ("id", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)


def url_key(url: str | None) -> str:
    """The key a URL is sorted by: host from the last label to the first, then path and query.

    ``http://www.example.org/a?b`` gives ``org,example,www)/a?b``. Scheme, user and fragment are left
    out, the host is lowered, and what has no host stands for itself; null is empty.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(
    id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE
) -> bytes:
    """One WARC record. A revisit has no payload and names the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    size = len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if id is None else id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields.insert(1, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.insert(2, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _number(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return int(value) if value else None


def parse(raw: bytes) -> dict:
    """The fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "id": _number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row to gzipped archives below ``folder``; returns a row per capture.

    Every record is a gzip member of its own, so that ``(file, offset, length)`` can be read alone.
    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is the
    response, the others are revisits of it; smaller ones are all responses. A null payload is empty,
    a null URL has the empty key; rows without an id are revisits where an equal payload has one. All
    rows of the largest id are responses. Other columns are not read.

    Equal payloads are found by digest with partial aggregation, and frequent digests are salted. Each
    attempt of a task writes files of new names: the captures that are kept name the files of the
    attempt that succeeded, others are never read.
    """
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), content.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    groups = written(
        large.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1"),
        "payloads",
    )
    hot = frequent_keys(groups, "digest", weight="copies")
    records = salted_join(rows, groups.select("digest", "last"), "digest", "id", hot, "left").select(
        "id",
        "url",
        F.when(F.col("last").eqNullSafe(F.col("id")), F.lit(None)).otherwise(F.col("last")).alias("refers_to"),
        "digest",
        "payload",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = None
        try:
            for batch in batches:
                found = []
                for row_id, row_url, refers_to, digest, raw in zip(
                    *(batch.column(i).to_pylist() for i in range(5)), strict=True
                ):
                    if out is None or place >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = _gzip(record(row_id, row_url, raw, digest, refers_to))
                    out.write(member)
                    found.append((url_key(row_url), row_id, name, place, len(member)))
                    place += len(member)
                columns = zip(*found, strict=True) if found else [[]] * 5
                arrays = [pa.array(list(c), f.type) for c, f in zip(columns, CAPTURE_SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=CAPTURE_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return written(records.mapInArrow(write, CAPTURES), "captures")


@dataclass(frozen=True)
class Index:
    """Where the index lies, and first and last key of each of its files, in the order of the keys."""

    folder: str
    archives: str
    files: tuple[tuple[str, str, str], ...]  # first key, last key, name


def write_index(captures: DataFrame, archives: str, folder: str, files: int | None = None) -> Index:
    """Sort captures by key into files of compressed blocks, each file with a directory at its end.

    The directory has the first key and the place of every block. The driver gets one row per file,
    and there are as many files as shuffle partitions, or ``files``. A key of very many captures runs
    on from block to block and from file to file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        directory: list[tuple[str, int, int]] = []
        lines: list[list] = []
        place, last = 0, ""
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:

            def flush() -> int:
                block = zlib.compress("\n".join(map(json.dumps, lines)).encode(), LEVEL)
                directory.append((lines[0][0], place, len(block)))
                out.write(block)
                lines.clear()
                return len(block)

            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    lines.append(list(row))
                    last = row[0]
                    if len(lines) == BLOCK_LINES:
                        place += flush()
            if lines:
                place += flush()
            end = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(end + len(end).to_bytes(8, "little"))
        if directory:
            yield pa.RecordBatch.from_arrays(
                [pa.array([directory[0][0]]), pa.array([last]), pa.array([name])], ["first", "last", "name"]
            )

    ordered = captures.repartitionByRange(files or partitions(captures), "key", "id")
    named = written(
        ordered.sortWithinPartitions("key", "id").mapInArrow(write, "first string, last string, name string"),
        "index",
    )
    rows = sorted((r.first, r.last, r.name) for r in named.collect())
    return Index(folder, archives, tuple(rows))


class _IndexFile:
    """One file of the index: its directory, and the block read last."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self._read(size - 8, 8), "little")
        directory = json.loads(zlib.decompress(self._read(size - 8 - length, length)))
        self.first = [key for key, _, _ in directory]
        self.places = [(place, length) for _, place, length in directory]
        self.block = functools.lru_cache(2)(self._block)

    def _read(self, place: int, length: int) -> bytes:
        return self.file.read_at(length, place)

    def _block(self, number: int) -> list[list]:
        raw = zlib.decompress(self._read(*self.places[number]))
        return [json.loads(line) for line in raw.decode().split("\n")]

    def find(self, key: str) -> Iterator[list]:
        """Captures of a key: the first block that may hold it by binary search, then onwards."""
        number = max(0, bisect.bisect_left(self.first, key) - 1)
        while number < len(self.first) and self.first[number] <= key:
            block = self.block(number)
            at = bisect.bisect_left(block, key, key=lambda line: line[0])
            while at < len(block) and block[at][0] == key:
                yield block[at]
                at += 1
            number += 1


def lookup(urls: DataFrame, index: Index, url: str = "url") -> DataFrame:
    """The captures of all URLs of a table; a URL that has none gives no row, a repeated one counts once.

    Keys find the files that may hold them by binary search over the files, and are dealt to them in
    order; there each finds its block by binary search over the directory, and the block is read by
    its range.
    """
    files = index.files
    wanted = urls.select(F.col(url).alias("url")).distinct()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [f[0] for f in files], [f[1] for f in files]
        for batch in batches:
            found = []
            for key in map(url_key, batch.column(0).to_pylist()):
                begin, end = bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)
                found.extend((number, key) for number in range(begin, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())],
                ["file", "key"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(index.folder)
        number, opened = -1, None
        for batch in batches:
            found: list[list] = []
            for want, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if want != number:
                    number, opened = want, _IndexFile(store, f"{base}/{files[want][2]}")
                for line in opened.find(key):
                    found.append(line)
                    if len(found) >= 10_000:
                        yield _captures(found)
                        found = []
            yield _captures(found)

    chosen = wanted.mapInArrow(choose, "file int, key string").distinct()
    ordered = chosen.repartitionByRange(partitions(urls), "file", "key").sortWithinPartitions("file", "key")
    return ordered.mapInArrow(read, CAPTURES)


def _captures(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, CAPTURE_SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=CAPTURE_SCHEMA)


RECORD = (
    "id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)
RECORD_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_records(captures: DataFrame, archives: str, payload: bool = True) -> DataFrame:
    """The records at the places of the captures, each read by its range.

    Captures are dealt by file and place, so a task reads a few files from front to back.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also of a revisit.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(archives)
        name, opened = "", None
        for batch in batches:
            rows, held = [], 0
            for file, place, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    name, opened = file, store.open_input_file(f"{base}/{file}")
                fields = parse(zlib.decompress(opened.read_at(length, place), 31))
                held += fields["payload_bytes"]
                if not payload:
                    fields["payload"] = None
                rows.append(fields)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)

    ordered = captures.select("file", "offset", "length").repartitionByRange(
        partitions(captures), "file", "offset"
    )
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def round_trip(
    spark: SparkSession, pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html"
) -> DataFrame:
    """Write archives and their index to the shared folder, look up every URL and read its records."""
    folder = scratch_path(spark, "warc")
    archives = f"{folder}/archives"
    captures = write_archives(pages, archives, id, url, payload)
    index = write_index(captures, archives, f"{folder}/index")
    return read_records(lookup(pages, index, url), archives, payload=False)
