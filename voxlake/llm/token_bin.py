"""Binary token files: canonical length-limited Huffman codes of token ids.

Texts are tokenized once; their ids are staged in the shared folder. Counts over all ids give
one code (package-merge, canonical order). Documents are dealt to files by ranges of their ids
(and of row numbers where ids are equal), coded and written in ascending order. Every file has
the code's lengths, blocks that can be decoded alone, and an index of the blocks at its end.

A block holds documents: id, number of tokens, coded bytes, and the bit offset of every
256th token. A reader decodes all stretches between these checkpoints side by side, one
table look-up a token each; one document, or the end of a long one, can be read alone.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import map_arrow, runs, table
from voxlake.llm.tokenizing import encoder
from voxlake.llm.warc import open_fs
from voxlake.session import cut, fresh_path, ship, stage

MAGIC = b"HUFTOK1\n"
MAX_BITS = 16
STRIDE = 256
#: Tokens that are coded at once.
SLICE = 1 << 20
#: Tokens of a block and of a file, about.
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23
#: Text that is tokenized at once.
TOKEN_RUN = 8 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``max_bits`` bits (more, if there are too many symbols); 0: unused."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels: list[np.ndarray] = []  # for each level, from the deepest: is the item a leaf?
    items, kinds = leaves, np.ones(n, dtype=bool)
    for _ in range(max_bits - 1):
        levels.append(kinds)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        items, kinds = both[sort], sort < n
    levels.append(kinds)
    take = 2 * (n - 1)
    depth = np.zeros(n, dtype=np.int64)
    for kinds in reversed(levels):
        leaf = int(np.count_nonzero(kinds[:take]))
        depth[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[order] = depth
    return lengths


class Code:
    """A canonical code: codes ascend with (length, symbol)."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.bits = int(lengths.max(initial=1))
        if self.bits > 24:
            raise ValueError("codes of more than 24 bits are not supported")
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = first >> (self.bits - lengths[order].astype(np.int64))
        size = 1 << self.bits
        self.symbol = np.zeros(size, dtype=np.uint32)
        self.length = np.full(size, self.bits, dtype=np.int64)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.length[: spans.sum()] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Coded bytes and checkpoints of documents that have ``sizes`` of the ids each (one at least), in slices of SLICE tokens.

        Checkpoints are 32-bit: a document of 2^32 coded bits or more (about 300 million tokens) is an error.
        """
        bits = self.lengths[ids]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        doc_bits = np.add.reduceat(bits, begins, dtype=np.int64)
        if doc_bits.max() >= 1 << 32:
            raise ValueError("a document of 2^32 coded bits or more")
        byte_ends = np.cumsum((doc_bits + 7) // 8)
        base = (byte_ends - (doc_bits + 7) // 8) * 8
        out = np.zeros(int(byte_ends[-1]) // 4 + 3, dtype=np.uint32)
        found, carry = [], 0
        for lo in range(0, len(ids), SLICE):
            hi = min(lo + SLICE, len(ids))
            width = bits[lo:hi].astype(np.int64)
            before = np.cumsum(width) - width
            first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(begins, hi, side="left")
            head = np.maximum(begins[first:last], lo) - lo
            offset = np.where(begins[first:last] >= lo, base[first:last], carry) - before[head]
            held = np.diff(head, append=hi - lo)
            at = before + np.repeat(offset, held)
            carry = int(at[-1] + width[-1])
            shifted = self.codes[ids[lo:hi]] << (64 - (at & 31) - width).astype(np.uint64)
            word = at >> 5
            cuts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[cuts]] |= np.bitwise_or.reduceat((shifted >> np.uint64(32)).astype(np.uint32), cuts)
            out[word[cuts] + 1] |= np.bitwise_or.reduceat((shifted & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)
            checked = np.flatnonzero((np.arange(lo, hi) - np.repeat(begins[first:last], held)) % STRIDE == 0)
            found.append((at[checked] - np.repeat(base[first:last], held)[checked]).astype("<u4"))
        raw = out.astype(">u4").tobytes()
        marks = np.concatenate(found).tobytes()
        marked = 4 * np.cumsum(-(-sizes // STRIDE))
        cut = lambda data, stops: [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return cut(raw, byte_ends.tolist()), cut(marks, marked.tolist())

    def decode(self, raw: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids of stretches of at most STRIDE tokens that begin at bit ``at``; all stretches advance together."""
        data = np.frombuffer(raw + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        order = np.argsort(-sizes, kind="stable")
        at, n = at[order].copy(), sizes[order]
        place = (np.cumsum(sizes) - sizes)[order]
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        mask = np.uint32((1 << self.bits) - 1)
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k, side="left"))
            p = at[:live]
            value = (window[p >> 3] >> (32 - self.bits - (p & 7)).astype(np.uint32)) & mask
            out[place[:live] + k] = self.symbol[value]
            at[:live] += self.length[value]
        return out


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with so many tokens: stretches of each, and tokens of every stretch."""
    count = -(-sizes // STRIDE)
    of = np.repeat(sizes, count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return count, np.minimum(of - nth * STRIDE, STRIDE)


class TokenFileWriter:
    """Writes one file of documents in the order given."""

    def __init__(self, sink: io.RawIOBase, lengths: np.ndarray) -> None:
        packed = zlib.compress(lengths.tobytes())
        self.sink, self.offset = sink, 0
        self._put(MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed)
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[tuple[int | None, int, bytes, bytes]] = []
        self.tokens = self.held_tokens = self.docs = 0

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.offset += len(raw)

    def add(self, doc_id: int | None, n: int, coded: bytes, marks: bytes) -> None:
        self.held.append((doc_id, n, coded, marks))
        self.held_tokens += n
        self.docs += 1
        if self.held_tokens >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids, sizes, coded, marks = zip(*self.held, strict=True)
        head = struct.pack("<I", len(ids)) + bytes(x is None for x in ids) + np.array([x or 0 for x in ids], "<i8").tobytes()
        head += np.array(sizes, "<u4").tobytes() + np.array([len(x) for x in coded], "<u4").tobytes() + b"".join(marks)
        at = self.offset
        self._put(head + b"".join(coded))
        self.index.append((at, self.offset - at, len(ids), self.held_tokens))
        self.tokens += self.held_tokens
        self.held, self.held_tokens = [], 0

    def finish(self) -> None:
        self.flush()
        raw = json.dumps(self.index).encode()
        self._put(raw + struct.pack("<I", len(raw)) + MAGIC)


class TokenFileReader:
    """Reads blocks of a file."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        end = source.size()
        (n,) = struct.unpack("<I", self._at(end - 12, 4))
        if self._at(end - 8, 8) != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.index = json.loads(self._at(end - 12 - n, n))
        symbols, size = struct.unpack("<II", self._at(8, 8))
        self.code = Code(np.frombuffer(zlib.decompress(self._at(16, size)), dtype=np.uint8, count=symbols))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Document ids, their numbers of tokens, and all their tokens in order."""
        offset, size, _, _ = self.index[k]
        raw = self._at(offset, size)
        (n,) = struct.unpack_from("<I", raw)
        at = 4 + n
        ids = [None if gone else i for gone, i in zip(raw[4:at], np.frombuffer(raw, "<i8", n, at).tolist(), strict=True)]
        sizes = np.frombuffer(raw, "<u4", n, at + 8 * n).astype(np.int64)
        lengths = np.frombuffer(raw, "<u4", n, at + 12 * n).astype(np.int64)
        count, stretch = _stretches(sizes)
        at += 16 * n
        marks = np.frombuffer(raw, "<u4", len(stretch), at).astype(np.int64)
        begins = np.repeat((np.cumsum(lengths) - lengths) * 8, count)
        return ids, sizes, self.code.decode(raw[at + 4 * len(stretch) :], begins + marks, stretch)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, n_tokens, ids): every text's ids and the end id, as unsigned 16- or 32-bit integers; n numbers the rows."""
    ready = docs.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("n"), F.col(text_column).alias("text"))

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 2, TOKEN_RUN):
            ids, sizes = encoder(tokenizer_path).encode_all(part.column(2), end_id)
            flat = ids.astype("<u4" if ids.max() >= 1 << 16 else "<u2", copy=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
            yield table({"id": (part.column(0), None), "n": (part.column(1), None), "n_tokens": (sizes, pa.int64()), "ids": (raw.cast(pa.binary()), None)})

    return map_arrow(ready, each, "id long, n long, n_tokens long, ids binary")


def _ids(raw: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The ids of all documents, one after another."""
    bounds = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset).astype(np.int64)
    width = np.diff(bounds) // sizes
    data = raw.buffers()[2]
    if (width == width[0]).all():
        return np.frombuffer(data, f"<u{width[0]}", int(sizes.sum()), int(bounds[0]))
    return np.concatenate([np.frombuffer(data, f"<u{w}", n, b).astype(np.uint32) for w, n, b in zip(width.tolist(), sizes.tolist(), bounds.tolist(), strict=False)])


def global_counts(staged: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; its size is that of the vocabulary."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for part in runs(batch, 1) if batch.num_rows else ():
                c = np.bincount(_ids(part.column(1), np.asarray(part.column(0))), minlength=len(total))
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield table({"token": (used, pa.int64()), "n": (total[used], pa.int64())})

    ship(staged.sparkSession)
    rows = staged.select("n_tokens", "ids").mapInArrow(each, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["token"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        out[r["token"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents in ascending id order; returns (part, path, n_docs, n_tokens, n_bytes) of each file.

    File ``part`` k holds lower ids than k + 1. A null text is the end id alone; null ids come
    first; equal ids are in the order of their rows and may go on in the next file, so a file is
    never larger for them; no rows, no file.
    """
    spark = docs.sparkSession
    staged = stage(tokenize(docs, tokenizer_path, end_id, id_column, text_column), "token-ids", "zstd")
    counts = global_counts(staged)
    lengths = code_lengths(counts)
    n_files = max(1, -(-int(counts.sum()) // FILE_TOKENS))
    ship(spark)
    dealt = staged.repartitionByRange(n_files, "id", "n").sortWithinPartitions("id", "n").select(F.spark_partition_id().alias("part"), "id", "n_tokens", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        code, writer, at = Code(lengths), None, 0
        for batch in batches:
            for part in runs(batch, 3) if batch.num_rows else ():
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    at = part.column(0)[0].as_py()
                    temporary = f"{base}/_{uuid.uuid4().hex}"
                    writer = TokenFileWriter(fs.open_output_stream(temporary), lengths)
                sizes = np.asarray(part.column(2))
                coded, marks = code.encode(_ids(part.column(3), sizes), sizes)
                for row in zip(part.column(1).to_pylist(), sizes.tolist(), coded, marks, strict=True):
                    writer.add(*row)
        done: list[tuple] = []
        if writer:
            writer.finish()
            writer.sink.close()
            name = f"{base}/{at:06d}-{uuid.uuid4().hex}.tok"
            fs.move(temporary, name)
            done.append((at, name, writer.docs, writer.tokens, writer.offset))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ("part", "path", "n_docs", "n_tokens", "n_bytes")
        yield table({c: ([d[i] for d in done], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    # the checkpoint keeps the names of the files that successful tasks wrote; others are not read
    return cut(dealt.mapInArrow(write, "part int, path string, n_docs long, n_tokens long, n_bytes long"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, decoded from them."""
    ship(files.sparkSession)
    # one row a file: their running sums are small
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ready = files.select("part", "path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for _, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    for k in range(len(reader.index)):
                        ids, sizes, tokens = reader.block(k)
                        raw = memoryview(tokens.astype("<u4").tobytes())
                        ends = np.cumsum(sizes)
                        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield table({"id": (ids, pa.int64()), "start": (start + ends - sizes, pa.int64()), "n_tokens": (sizes, pa.int64()), "ids_crc32": (crc, pa.int64())})
                        start += int(ends[-1])

    n = max(1, files.count())
    return ready.repartitionByRange(n, "part").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents as token files in the shared folder, then describe every document from the files."""
    folder = fresh_path(docs.sparkSession, "tokens")
    files = write_token_files(docs, folder, tokenizer_path, end_id, id_column, text_column)
    return read_token_files(files, folder).withColumnRenamed("id", id_column)
