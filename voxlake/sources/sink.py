"""Writing volumes from block rows.

A volume is written by many tasks: each lays the blocks of a range of sections into one section
after another, takes the moments of each, and writes their bytes (compressed on their own, if
asked for) as a part under a temporary name in the target folder. The commit on the driver merges
the moments of all parts, writes header and parts as one file, and moves it to its name; sections
without a block are zeros. Tasks may run twice and a failed job leaves nothing. The header's statistics
are those of the whole file; with ``statistics`` "blocks", of the voxels that blocks gave.

Voxels must have the file's type: signed bytes for mode 0, shorts for 1, unsigned shorts (as ints, or
bytes from 0 to 255 as shorts) for 6, pairs for 3 and 4, 0 to 15 for 101. Floats are converted to
every real mode but 101, clamped and truncated; whole numbers of another type only with ``convert``.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from voxlake import errors as E
from voxlake.functions.header import Header, add_label, encode_header, new_header, set_endian, with_extra
from voxlake.functions.modes import Mode, data_bytes, dtype, mode_of
from voxlake.operators.stats import SENTINELS, Moments, merge_moments, moments
from voxlake.sources.volume_file import convert_box, open_fs, pack_rows, strict_problem

#: Compression levels by name, and what they are for gzip (bzip2 has no 0).
LEVELS = {"none": 0, "fast": 1, "balanced": 6, "best": 9}
#: Bytes of sections in a part, about; parts that the commit joins at the same time, and bytes that it copies at once.
PART_BYTES = 64 << 20
COMMITTERS, COPY_BYTES = 8, 16 << 20
_WRITABLE = {0: "byte", 1: "short", 2: "float", 6: "ushort", 12: "half"}


@dataclass(frozen=True)
class VolumeBuilder:
    """What a new file's header says; every setter returns a new builder."""

    shape: tuple[int, int, int]
    mode: int = 2
    cell_lengths: tuple[float, float, float] = (1.0, 1.0, 1.0)
    cell_angles: tuple[float, float, float] = (90.0, 90.0, 90.0)
    ispg: int = 1
    sampling: tuple[int, int, int] | None = None
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    nstart: tuple[int, int, int] = (0, 0, 0)
    axis_mapping: tuple[int, int, int] = (1, 2, 3)
    exttyp: str = ""
    nsymbt: int | None = None
    extended_header: bytes = b""
    labels: tuple[str, ...] = field(default=())
    endian: str = "little"
    #: Header fields by name that replace what the other settings make.
    fields: tuple[tuple[str, object], ...] = field(default=())

    def image_stack(self) -> VolumeBuilder:
        return replace(self, ispg=0, sampling=(self.shape[0], self.shape[1], 1))

    def volume(self) -> VolumeBuilder:
        return replace(self, ispg=1, sampling=self.shape)

    def volume_stack(self, mz: int) -> VolumeBuilder:
        return replace(self, ispg=401, sampling=(self.shape[0], self.shape[1], mz))

    def label(self, text: str) -> VolumeBuilder:
        return replace(self, labels=(*self.labels, text))

    def big_endian(self) -> VolumeBuilder:
        return replace(self, endian="big")

    def header_fields(self, **values: object) -> VolumeBuilder:
        """Any fields of the header by name; the shape and mode are the builder's."""
        if {"nx", "ny", "nz", "mode", "nsymbt", "labels", "extra", "map", "machst"} & set(values):
            raise E.InvalidHeader("shape, mode, extended header, labels and stamps have settings of their own")
        return replace(self, fields=(*self.fields, *values.items()))

    def build(self) -> Header:
        """The header, checked by the strict rules."""
        mx, my, mz = self.sampling or self.shape
        n = self.nsymbt if self.nsymbt is not None else len(self.extended_header)
        named = {"mx": mx, "my": my, "mz": mz, "ispg": self.ispg, "nsymbt": n, "origin": tuple(self.origin)}
        for names, values in ((("xlen", "ylen", "zlen"), self.cell_lengths), (("alpha", "beta", "gamma"), self.cell_angles), (("nxstart", "nystart", "nzstart"), self.nstart), (("mapc", "mapr", "maps"), self.axis_mapping)):
            named |= dict(zip(names, values, strict=True))
        h = set_endian(new_header(*self.shape, self.mode, **named | dict(self.fields)), self.endian)
        if self.exttyp:
            if len(self.exttyp.encode()) != 4:
                raise E.InvalidHeader("EXTTYP must have four bytes")
            h = with_extra(h, 8, self.exttyp.encode())
        for text in self.labels:
            h = add_label(h, text)
        problem = strict_problem(h)
        if problem:
            raise E.InvalidHeaderDetailed(*problem)
        return h

    def extended(self) -> bytes:
        n = self.nsymbt if self.nsymbt is not None else len(self.extended_header)
        return self.extended_header[:n].ljust(n, b"\0")

    def options(self) -> dict[str, str]:
        """As options of the writer."""
        comma = lambda x: ",".join(map(str, x))
        out = {"nx": self.shape[0], "ny": self.shape[1], "nz": self.shape[2], "voxelMode": self.mode, "ispg": self.ispg, "origin": comma(self.origin), "nstart": comma(self.nstart), "axisMapping": comma(self.axis_mapping), "cellLengths": comma(self.cell_lengths), "cellAngles": comma(self.cell_angles), "exttyp": self.exttyp, "extendedHeader": self.extended_header.hex(), "labels": "\n".join(self.labels), "endian": self.endian, "headerFields": json.dumps(dict(self.fields))}
        if self.sampling:
            out["sampling"] = comma(self.sampling)
        if self.nsymbt is not None:
            out["nsymbt"] = self.nsymbt
        return {k: str(v) for k, v in out.items()}

    @classmethod
    def from_options(cls, options: dict[str, str]) -> VolumeBuilder:
        o = {k.lower(): v for k, v in options.items()}
        numbers = lambda k, kind: tuple(kind(x) for x in o[k].split(","))
        out = cls((int(o["nx"]), int(o["ny"]), int(o["nz"])), int(o.get("voxelmode", 2)), ispg=int(o.get("ispg", 1)), exttyp=o.get("exttyp", ""), extended_header=bytes.fromhex(o.get("extendedheader", "")))
        for key, name, kind in (("origin", "origin", float), ("nstart", "nstart", int), ("axismapping", "axis_mapping", int), ("celllengths", "cell_lengths", float), ("cellangles", "cell_angles", float), ("sampling", "sampling", int)):
            if o.get(key):
                out = replace(out, **{name: numbers(key, kind)})
        if o.get("nsymbt"):
            out = replace(out, nsymbt=int(o["nsymbt"]))
        more = json.loads(o.get("headerfields") or "{}")
        return replace(out, labels=tuple(x for x in o.get("labels", "").split("\n") if x), endian=o.get("endian", "little"), fields=tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in more.items()))


def _checked(values: np.ndarray, low: int, high: int, what: str) -> np.ndarray:
    if values.size and (values.min() < low or values.max() > high):
        raise E.ValueOutOfRange(f"{what} are {low} to {high}")
    return values


def block_values(data: pa.Array, mode: Mode, convert: bool = False) -> np.ndarray:
    """A block's numbers in the file's type; see the module for what is accepted."""
    if pa.types.is_struct(data.type):
        parts = [data.field(k) for k in ("re", "im")]
        if not mode.is_complex or pa.types.is_integer(parts[0].type) != (mode.code == 3):
            raise E.ModeMismatch(f"complex voxels of {parts[0].type} in a file of mode {mode.code}")
        return np.stack([np.asarray(x) for x in parts], axis=-1).astype(np.dtype(mode.numpy))
    if mode.is_complex:
        raise E.ModeMismatch(f"real voxels in a file of mode {mode.code}")
    values = np.asarray(data)
    if pa.types.is_floating(data.type):
        if mode.code == 101:
            raise E.UnsupportedMode("floats are not converted to packed voxels")
        return convert_box(values, mode_of(2), _WRITABLE[mode.code])
    if mode.code == 101:
        return _checked(values, 0, 15, "packed voxels").astype(np.int8)
    if convert:
        return convert_box(values, mode_of(2), _WRITABLE[mode.code])
    if mode.code == 6 and pa.types.is_int16(data.type):
        return _checked(values, 0, 255, "bytes for unsigned voxels")
    if mode.code == 6 and pa.types.is_int32(data.type):
        return _checked(values, 0, 65535, "unsigned voxels")
    if {0: pa.int8(), 1: pa.int16()}.get(mode.code) != data.type:
        raise E.ModeMismatch(f"voxels of {data.type} in a file of mode {mode.code}")
    return values


def header_stats(parts: list[tuple[Moments, Moments]], is_complex: bool) -> tuple[float, float, float, float]:
    """dmin, dmax, dmean, rms from the moments (of real and imaginary parts) of all sections."""
    n, low, high, mean, m2 = merge_moments([a for a, _ in parts])
    if not n:
        return SENTINELS
    if is_complex:
        return (*SENTINELS[:3], float(np.sqrt((m2 + merge_moments([b for _, b in parts])[4]) / n)))
    return low, high, mean, float(np.sqrt(m2 / n))


class Sections:
    """Writes sections, in order, from blocks that come in the order of their first section."""

    def __init__(self, builder: VolumeBuilder, sink: io.IOBase, convert: bool = False, statistics: str = "file") -> None:
        self.builder, self.sink, self.convert, self.statistics = builder, sink, convert, statistics
        self.mode = mode_of(builder.mode)
        nx, ny, _ = builder.shape
        self.shape = (ny, nx, 2) if self.mode.is_complex else (ny, nx)
        self.kind = np.dtype("i1") if self.mode.code == 101 else dtype(self.mode, builder.endian)
        self.pending: dict[int, np.ndarray] = {}
        #: Voxels that a block gave, of pending sections; only kept for their statistics.
        self.given: dict[int, np.ndarray] = {}
        self.first = self.next = None
        self.moments: list[tuple[Moments, Moments]] = []

    def put(self, offset: tuple[int, int, int], size: tuple[int, int, int], data: pa.Array) -> None:
        nx, ny, nz = self.builder.shape
        if any(o < 0 or s < 0 or o + s > n for o, s, n in zip(offset, size, (nx, ny, nz), strict=True)):
            raise E.BoundsError(f"block {offset}+{size} is not inside {self.builder.shape}")
        if len(data) != size[0] * size[1] * size[2]:
            raise E.BlockShapeMismatch(f"{len(data)} values for {size}")
        (ox, oy, oz), (sx, sy, sz) = offset, size
        if self.next is not None and oz < self.next:
            raise E.VolumeIOError("blocks must come in the order of their sections; write_volume sorts them")
        self.flush(oz)
        values = block_values(data, self.mode, self.convert)
        values = values.reshape(sz, sy, sx, *values.shape[1:])
        for k in range(sz):
            section = self.pending.setdefault(oz + k, np.zeros(self.shape, self.kind))
            section[oy : oy + sy, ox : ox + sx] = values[k]
            if self.statistics == "blocks":
                self.given.setdefault(oz + k, np.zeros((ny, nx), bool))[oy : oy + sy, ox : ox + sx] = True

    def flush(self, upto: int) -> None:
        """Write all sections below ``upto``, from the first that has a block."""
        while self.pending and (z := min(self.pending)) < upto:
            if self.first is None:
                self.first = self.next = z
            for section in (np.zeros(self.shape, self.kind) for _ in range(self.next, z)):
                self._write(section)
            self._write(self.pending.pop(z), self.given.pop(z, None))

    def _write(self, section: np.ndarray, given: np.ndarray | None = None) -> None:
        self.sink.write(pack_rows(section) if self.mode.code == 101 else section.tobytes())
        if self.statistics == "blocks":
            section = section[:0] if given is None else section[given]
        parts = [section[..., k] for k in (0, 1)] if self.mode.is_complex else [section, section[:0]]
        self.moments.append(tuple(map(moments, parts)))
        self.next += 1

    def zeros(self, n: int) -> None:
        """Write n sections without blocks."""
        self.next = self.next or 0
        for _ in range(n):
            self._write(np.zeros(self.shape, self.kind))


def head_bytes(builder: VolumeBuilder, parts: list[tuple[Moments, Moments]]) -> bytes:
    """Header with its statistics, and extended header."""
    low, high, mean, rms = header_stats(parts, mode_of(builder.mode).is_complex)
    h = builder.build()
    return encode_header(replace(h, values=h.values | {"dmin": low, "dmax": high, "dmean": mean, "rms": rms})) + builder.extended()


def _compressor(sink: object, kind: str, level: str):  # noqa: ANN202
    n = LEVELS.get(level, int(level) if level.isdigit() else 6)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=n, mtime=0)
    if kind == "bzip2":
        return bz2.BZ2File(sink, "wb", compresslevel=max(1, n))
    return None


@dataclass
class Part:
    """Sections z0 to z1 of a volume in a file of their own."""

    volume: str
    z0: int
    z1: int
    path: str
    moments: list[tuple[Moments, Moments]]


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        self.schema, self.o, self.overwrite = schema, {k.lower(): v for k, v in options.items()}, overwrite
        self.builder = VolumeBuilder.from_options(options)
        self.builder.build()
        self.compression = self.o.get("compression", "none").lower()
        self.level = self.o.get("compressionlevel", "balanced").lower()
        self.statistics = self.o.get("statistics", "file").lower()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_fs(self.o["path"])
        fs.create_dir(folder, recursive=True)
        per_part, convert = sections_of_part(self.builder, self.o), self.o.get("convert", "false").lower() == "true"
        parts: list[Part] = []
        key, sections, sink, packed = None, None, None, None

        def close() -> None:
            if sections is None:
                return
            sections.flush(self.builder.shape[2])
            if packed:
                packed.close()
            sink.close()
            parts.append(Part(key[0], sections.first or 0, sections.next or 0, temporary, sections.moments))

        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                name = columns["path"][i].as_py() if "path" in columns else "volume"
                at = [columns[k][i].as_py() for k in ("ox", "oy", "oz", "sx", "sy", "sz")]
                if (name, at[2] // per_part) != key:
                    close()
                    key, temporary = (name, at[2] // per_part), f"{folder}/_{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temporary)
                    packed = _compressor(sink, self.compression, self.level)
                    sections = Sections(self.builder, packed or sink, convert, self.statistics)
                sections.put(tuple(at[:3]), tuple(at[3:]), columns["data"][i].values)
        close()
        return Written(parts)

    def _join(self, fs: pafs.FileSystem, name: str, parts: list[Part]) -> None:
        """One file of header, parts and zeros where there are none."""
        parts = sorted(parts, key=lambda p: p.z0)
        if any(a.z1 > b.z0 for a, b in zip(parts, parts[1:], strict=False)):
            raise E.VolumeIOError(f"sections of {name} came from several tasks; write_volume deals them by section")
        temporary = f"{os.path.dirname(name)}/_{uuid.uuid4().hex}"
        edges = [0, *(z for p in parts for z in (p.z0, p.z1)), self.builder.shape[2]]
        gaps = [b - a for a, b in zip(edges[::2], edges[1::2], strict=True)]
        empty = Sections(self.builder, io.BytesIO(), statistics=self.statistics)
        empty.zeros(min(1, max(gaps)))
        found = [m for p in parts for m in p.moments] + empty.moments * sum(gaps)
        blank = empty.sink.getvalue()
        with fs.open_output_stream(temporary) as sink:

            def own(pieces: Iterator[bytes]) -> None:
                packed = _compressor(sink, self.compression, self.level)
                for piece in pieces:
                    (packed or sink).write(piece)
                if packed:
                    packed.close()

            own([head_bytes(self.builder, found)])
            for gap, part in zip(gaps, [*parts, None], strict=True):
                if gap:
                    own(blank for _ in range(gap))
                if part:
                    with fs.open_input_stream(part.path) as source:
                        while piece := source.read(COPY_BYTES):
                            sink.write(piece)
        fs.move(temporary, name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = open_fs(self.o["path"])
        volumes: dict[str, list[Part]] = {}
        for p in (p for m in messages if m for p in m.parts):
            volumes.setdefault(p.volume, []).append(p)
        ending = ".vol" + {"gzip": ".gz", "bzip2": ".bz2"}.get(self.compression, "")
        names = {v: f"{folder}/{os.path.basename(v.rstrip('/')).split('.')[0] or 'volume'}{ending}" for v in volumes}
        if len(set(names.values())) < len(names):
            raise E.VolumeIOError("two volumes have the same file name")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if f.type == pafs.FileType.File and not f.base_name.startswith("_"):
                    fs.delete_file(f.path)
        with ThreadPoolExecutor(COMMITTERS) as pool:
            list(pool.map(lambda v: self._join(fs, names[v], volumes[v]), volumes))
        self._drop(fs, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(open_fs(self.o["path"])[0], messages)

    @staticmethod
    def _drop(fs: pafs.FileSystem, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for p in m.parts if m else []:
                fs.delete_file(p.path)


def sections_of_part(builder: VolumeBuilder, options: dict[str, str]) -> int:
    plane = max(1, data_bytes(*builder.shape[:2], 1, mode_of(builder.mode)))
    return int(options.get("sectionsperpart") or max(1, PART_BYTES // plane))


def by_section(blocks: DataFrame) -> DataFrame:
    """Block rows of one section each."""
    k, sx, sy, sz = (F.col(c) for c in ("k", "sx", "sy", "sz"))
    plane = sx * sy
    # what is left over stays with the last section, where the size is checked
    length = F.when(k == sz - 1, F.greatest(F.size("data") - k * plane, F.lit(0))).otherwise(plane)
    own = F.when(sz == 1, F.col("data")).otherwise(F.slice("data", k * plane + 1, length))
    cut = blocks.where("sz > 0").withColumn("k", F.explode(F.sequence(F.lit(0), sz - 1)))
    return cut.withColumns({"data": own, "oz": (F.col("oz") + k).cast("int"), "sz": F.lit(1)}).drop("k")


def write_volume(blocks: DataFrame, folder: str, builder: VolumeBuilder, compression: str = "none", level: str = "balanced", mode: str = "append", convert: bool = False, sections_per_part: int | None = None, statistics: str = "file") -> None:
    """Write block rows as volumes, one for each value of ``path`` (or one); ranges of sections are dealt to tasks."""
    from voxlake.sources.volumetric import register

    register(blocks.sparkSession)
    rows = blocks if "path" in blocks.columns else blocks.withColumn("path", F.lit("volume"))
    options = builder.options() | {"compression": compression, "compressionLevel": level, "convert": str(convert).lower(), "statistics": statistics}
    if sections_per_part:
        options["sectionsPerPart"] = str(sections_per_part)
    per_part = sections_of_part(builder, {k.lower(): v for k, v in options.items()})
    # AQE puts small ranges of sections into one task; each stays a part of its own
    dealt = by_section(rows).withColumn("part_of", F.floor(F.col("oz") / per_part)).repartition("path", "part_of")
    ordered = dealt.sortWithinPartitions("path", "oz", "oy", "ox").drop("part_of")
    ordered.write.format("volumetric").options(**options).mode(mode).save(folder)


def encode_volumes(blocks: DataFrame, builder: VolumeBuilder, convert: bool = False) -> DataFrame:
    """(path, content): whole files as binary values, for volumes well below 2 GiB."""
    from voxlake.session import ship

    ship(blocks.sparkSession)

    def one(rows: pa.Table) -> pa.Table:
        body = io.BytesIO()
        sections = Sections(builder, body, convert)
        at = {k: rows.column(k).to_pylist() for k in ("ox", "oy", "oz", "sx", "sy", "sz")}
        data = rows.column("data").combine_chunks()
        order = sorted(range(rows.num_rows), key=lambda i: (at["oz"][i], at["oy"][i], at["ox"][i]))
        sections.zeros(at["oz"][order[0]])
        for i in order:
            sections.put(tuple(at[k][i] for k in ("ox", "oy", "oz")), tuple(at[k][i] for k in ("sx", "sy", "sz")), data[i].values)
        sections.flush(builder.shape[2])
        sections.zeros(builder.shape[2] - sections.next)
        return pa.table({"path": rows.column("path")[:1], "content": pa.array([head_bytes(builder, sections.moments) + body.getvalue()], pa.binary())})

    return blocks.groupBy("path").applyInArrow(one, "path string, content binary")


def expected_bytes(builder: VolumeBuilder) -> int:
    return 1024 + len(builder.extended()) + data_bytes(*builder.shape, mode_of(builder.mode))
