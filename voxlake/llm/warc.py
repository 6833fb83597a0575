"""WARC archives as seekable Zstandard bundles, with revisits of equal payloads.

A bundle is a row of independent Zstandard frames, each of whole WARC records, then two
skippable frames: the record index (for each record: its identifier, frame, offset within the
frame's content and length) and the seek table of the Zstandard seekable format (compressed
and plain size of every frame), which is found from the end of the file. A reader that wants
one record decodes one frame.

Files are written under temporary names and renamed, so a task that runs twice leaves one
whole file. They lie in the shared folder and are opened through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import table, with_value
from voxlake.session import cut, fresh_path, ship

#: Plain bytes of a frame, about; a longer record has a frame of its own.
FRAME_BYTES = 1 << 18
#: Plain bytes of a file, about; a task that has more writes several.
FILE_BYTES = 256 << 20
LEVEL = 3
SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
DATE = "2020-01-01T00:00:00Z"
#: A table of the digests that occur twice or more is broadcast up to so many rows (under 64 MB), else joined by shuffle.
BROADCAST_DIGESTS = 200_000


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in the shared storage."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:page:{page_id}>"


def page_of(identifier: str) -> str:
    return identifier.removeprefix("<urn:page:").removesuffix(">")


def _clean(value: str) -> str:
    """A header value: line ends and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """A response with its payload, or a revisit without it; both tell the full payload's digest and size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse_record(raw: bytes) -> Record:
    """One record; its payload is checked against its digest if it is a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    if headers["WARC-Type"] == "response" and "sha1:" + digest(payload) != headers["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    return Record(headers, http, payload)


class BundleWriter:
    """Writes one bundle."""

    def __init__(self, sink: io.RawIOBase, frame_bytes: int = FRAME_BYTES) -> None:
        import zstandard

        self.frame_bytes = frame_bytes
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.total = 0

    def add(self, identifier: str, record: bytes) -> None:
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        self.index.append((identifier, len(self.frames), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        self.total += len(record)

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        self.flush()
        body = self.compressor.compress(json.dumps(self.index).encode())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<II", 8 + len(body), 0)
        footer = struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(footer)) + seek + footer)


class BundleReader:
    """Reads a bundle from its end: seek table, record index, then single frames."""

    def __init__(self, source: pa.NativeFile) -> None:
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        sizes = [*struct.iter_unpack("<II", self._at(size - 9 - 8 * n, 8 * n))]
        self.offsets, at = [], 0
        for packed, plain in sizes[:-1]:
            self.offsets.append((at, packed, plain))
            at += packed
        body = self._at(at + 8, sizes[-1][0] - 8)
        self.index: list[list] = json.loads(self.decompressor.decompress(body))
        self.places = {identifier: (k, start, length) for identifier, k, start, length in self.index}

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.offsets[k]
        return self.decompressor.decompress(self._at(at, packed), max_output_size=plain)

    def record(self, identifier: str) -> Record:
        """One record by its identifier; decodes its frame only."""
        k, start, length = self.places[identifier]
        return parse_record(self.frame(k)[start : start + length])

    def __iter__(self) -> Iterator[Record]:
        k, content = -1, b""
        for _, frame, start, length in self.index:
            if frame != k:
                k, content = frame, self.frame(frame)
            yield parse_record(content[start : start + length])


def with_refers_to(pages: DataFrame, id_column: str, payload_column: str, least_bytes: int) -> DataFrame:
    """id, url, payload and the id of the record to revisit (null for responses)."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(id_column).alias("id"), F.col("url"), payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256))
    # the payloads stay where they are: only digests that occur twice or more go any further
    again = keyed.select(key.alias("key"), "id").where(F.col("key").isNotNull()).groupBy("key").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = cut(again.where((F.col("n") > 1) & F.col("last").isNotNull()).select("key", "last", "n"))
    marked = keyed.withColumn("key", key)
    if again.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        joined = marked.join(F.broadcast(again.drop("n")), "key", "left")
    else:
        # a digest that many rows share must not bring their payloads together in one task
        spread = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
        values = again.select(F.col("key").alias("of"), F.col("last").alias("value"), "n")
        joined = with_value(marked.withColumn("spread", spread), "key", "spread", values, again.agg(F.sum("n")).first()[0]).withColumnRenamed("value", "last")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record for every row; returns (path, n_records) of each file, already written.

    Of equal payloads of at least ``least_bytes`` bytes, that with the largest id is a response
    and the others revisit it. A null payload is empty; a null id is written as ``None``, and
    refers to the largest id of its payload; rows that repeat the largest id are responses all.
    """
    ready = with_refers_to(pages, id_column, payload_column, least_bytes)
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        writer = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            writer.finish()
            writer.sink.close()
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            fs.move(writer.name, name)
            done.append((name, len(writer.index)))

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page, url, payload, refers = (c[i].as_py() for c in columns)
                if writer is None:
                    temporary = f"{base}/_{uuid.uuid4().hex}"
                    writer = BundleWriter(fs.open_output_stream(temporary), frame_bytes)
                    writer.name = temporary
                writer.add(record_id(page), warc_record(page, url, payload, refers))
                if writer.total >= FILE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield table({"path": ([p for p, _ in done], pa.string()), "n_records": ([n for _, n in done], pa.int64())})

    # the checkpoint keeps the names of the files that successful tasks wrote; others are not read
    return cut(ready.mapInArrow(write, "path string, n_records long"))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest, url) of every record in the files."""
    spark = files.sparkSession
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(path) as source:
                    for r in BundleReader(source):
                        h = r.headers
                        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), int(r.http["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h.get("WARC-Target-URI")))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    schema = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, url string"
    return files.select("path").mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url")
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return table({n: ([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html") -> DataFrame:
    """Write all rows as archives in the shared folder, then describe every row from the files."""
    folder = fresh_path(pages.sparkSession, "warc")
    kind = pages.schema[id_column].dataType.simpleString()
    records = read_archives(write_archives(pages, folder, id_column, payload_column), folder)

    def page(c: str) -> F.Column:
        return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("None")).cast(kind)

    return records.select(page("record_id").alias(id_column), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "url")


#: What op5 must give; base32 is spelled from each five hexadecimal digits of the digest.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM d
"""
