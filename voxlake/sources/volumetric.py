"""The ``volumetric`` data source.

    spark.read.format("volumetric").option("content", "headers" | "blocks" | "voxels").load(path)
    blocks.write.format("volumetric").option("nx", ..).option("ny", ..).option("nz", ..).save(folder)

Reading: a task reads contiguous ranges of sections (``slab`` sections a row, 64 MiB of output
a row at most); a compressed file is one task. ``region`` and comparisons of z, y, x (voxels) or
oz, oy, ox (blocks) with whole numbers are pushed down to byte ranges and files. Other options: ``mode``
STRICT or PERMISSIVE, ``compression``, ``maxDecompressedBytes``, ``valueType``, ``complexStrategy``,
``m0`` auto, signed or unsigned, ``rounding``, ``modes`` (voxel modes; files of others are left out).

Files whose native types differ need a ``valueType``; without one, planning raises TypeMismatch.
``valueType`` ubyte takes packed and unsigned voxels of 0 to 255 as they are; more is an error.

Writing: see ``sources.sink``. Each task writes ranges of sections, the commit joins them to files
and writes the header with statistics merged from the tasks.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from voxlake import errors as E
from voxlake.functions.header import HEADER_TYPE, IMOD_TYPE, imod_fields
from voxlake.functions.modes import Mode, data_bytes, mode_of
from voxlake.session import ship
from voxlake.sources.volume_file import MAX_DECOMPRESSED, TARGETS, Volume, convert_box, open_fs, open_volume, peek_volume

#: Bytes of output in a block row, about, where no slab is asked for; and bytes that a task reads.
ROW_BYTES = 8 << 20
TASK_BYTES = 64 << 20
#: Headers that planning reads at the same time.
PLANNERS = 32

VALUE_TYPES = {"float": T.FloatType(), "half": T.FloatType(), "short": T.ShortType(), "ushort": T.IntegerType(), "byte": T.ByteType(), "ubyte": T.ShortType()}
HEADERS_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("endian", T.StringType()),
        T.StructField("standard_stamp", T.BooleanType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("m0_unsigned", T.BooleanType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("ext_header", T.BinaryType()),
        T.StructField("header", HEADER_TYPE),
        T.StructField("imod", IMOD_TYPE),
    ]
)


def list_files(path: str) -> list[str]:
    """Files at a path, in a folder, or by a local glob pattern; hidden ones are left out."""
    if "://" not in path and any(c in path for c in "*?["):
        return sorted(glob.glob(path))
    fs, local = open_fs(path)
    info = fs.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise E.VolumeIOError(f"no such file: {path}")
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(local.rstrip("/"))] if path.rstrip("/").endswith(local.rstrip("/")) else ""
    found = fs.get_file_info(pafs.FileSelector(local, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def value_type(mode: Mode, target: str, unsigned: bool = False) -> T.DataType:
    if target == "raw":
        return T.BinaryType()
    if target != "native":
        return VALUE_TYPES[target]
    return T.ShortType() if mode.code == 0 and unsigned else mode.spark


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@dataclass
class Sections(InputPartition):
    """Sections z0 to z1 of a file."""

    path: str
    z0: int
    z1: int


def wanted_modes(options: dict[str, str]) -> set[int] | None:
    return {int(m) for m in options["modes"].split(",")} if options.get("modes") else None


def is_unsigned(v: Volume, options: dict[str, str]) -> bool:
    m0 = options.get("m0", "auto")
    return v.header.mode == 0 and (v.header.imod_unsigned() if m0 == "auto" else m0 == "unsigned")


class VolumeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.o = schema, options
        self.content = options.get("content", "blocks")
        self.low = {a: 0 for a in "xyz"}
        self.high: dict[str, int | None] = {a: None for a in "xyz"}
        if options.get("region"):
            n = [int(x) for x in options["region"].split(",")]
            self.region: tuple | None = (tuple(n[:3]), tuple(n[3:]))
        else:
            self.region = None
        self.modes = wanted_modes(options)

    def _open(self, path: str) -> Volume:
        o = self.o
        return open_volume(path, self._permissive(), o.get("compression", "auto"), int(o.get("maxDecompressedBytes") or o.get("maxdecompressedbytes") or MAX_DECOMPRESSED))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on whole numbers narrow the boxes that are read. All filters are also applied again by Spark, which keeps them exact."""
        names = {"voxels": {"x": "x", "y": "y", "z": "z"}, "blocks": {"ox": "x", "oy": "y", "oz": "z"}}.get(self.content, {})
        for f in filters:
            yield f
            if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in names or not isinstance(getattr(f, "value", None), int):
                continue
            a, v = names[f.attribute[0]], f.value
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.low[a] = max(self.low[a], v)
            if isinstance(f, GreaterThan):
                self.low[a] = max(self.low[a], v + 1)
            top = v + 1 if isinstance(f, (EqualTo, LessThanOrEqual)) else v if isinstance(f, LessThan) else None
            if top is not None:
                self.high[a] = top if self.high[a] is None else min(self.high[a], top)

    def _permissive(self) -> bool:
        return self.o.get("mode", "STRICT").upper() == "PERMISSIVE"

    def _peek(self, path: str) -> Volume | None:
        """The header for planning; what permissive reading cannot use either is left out there, and an error here."""
        try:
            v = peek_volume(path, self.o.get("compression", "auto"))
            mode_of(v.header.mode)
            if min(v.shape) <= 0:
                raise E.InvalidHeaderDetailed("InvalidDimensions", f"{v.shape}")
        except E.VolumeError:
            if self._permissive():
                return None
            raise
        return v

    def _box(self, v: Volume) -> tuple[list[int], list[int]]:
        """Begin and end (x, y, z) of what is asked for."""
        begin, end = [0, 0, 0], list(v.shape)
        if self.region:
            (offset, size) = self.region
            if any(o < 0 or s < 0 or o + s > n for o, s, n in zip(offset, size, v.shape, strict=True)):
                raise E.BoundsError(f"box {offset}+{size} is not inside {v.shape}")
            begin, end = list(offset), [o + s for o, s in zip(offset, size, strict=True)]
        for k, a in enumerate("xyz"):
            low, high = self.low[a], end[k] if self.high[a] is None else min(end[k], self.high[a])
            if self.content == "voxels":
                begin[k], end[k] = max(begin[k], low), high
            elif a == "z":
                # blocks keep their grid: from the first that begins at low to the last that begins below high
                step = self._step(v)
                first = begin[k] + max(0, -(-(low - begin[k]) // step)) * step
                end[k] = min(end[k], begin[k] + max(0, -(-(high - begin[k]) // step)) * step)
                begin[k] = first
            elif not low <= begin[k] < high:
                end[k] = begin[k]
        return begin, end

    def _wanted(self, v: Volume) -> bool:
        return self.modes is None or v.header.mode in self.modes

    def _check_types(self, volumes: list[Volume]) -> None:
        """Without a value type, all files must have that of the schema."""
        if (self.o.get("valueType") or self.o.get("valuetype") or "native") != "native":
            return
        field = self.schema["data"].dataType.elementType if self.content == "blocks" else self.schema["value"].dataType
        for v in volumes:
            kind = value_type(v.mode, "native", is_unsigned(v, self.o))
            if kind != field:
                raise E.TypeMismatch(f"{v.path} has voxels of {kind.simpleString()}, the schema {field.simpleString()}; name a valueType, or modes to read apart")

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.o["path"])
        if self.content == "headers":
            return [Sections(p, 0, 0) for p in files] or [Sections("", 0, 0)]
        out: list[InputPartition] = []
        with ThreadPoolExecutor(PLANNERS) as pool:
            peeked = list(pool.map(self._peek, files))
        self._check_types([v for v in peeked if v and self._wanted(v)])
        for p, v in zip(files, peeked, strict=True):
            if v is None or not self._wanted(v):
                continue
            begin, end = self._box(v)
            if any(b >= e for b, e in zip(begin, end, strict=True)):
                continue
            plane = max(1, data_bytes(v.shape[0], v.shape[1], 1, v.mode))
            step = self._step(v)
            per_task = end[2] - begin[2] if v.compression != "plain" else max(step, TASK_BYTES // plane // step * step)
            out += [Sections(p, z, min(z + per_task, end[2])) for z in range(begin[2], end[2], per_task)]
        return out or [Sections("", 0, 0)]

    def _step(self, v: Volume) -> int:
        """Sections of a block row."""
        if self.o.get("slab"):
            return max(1, int(self.o["slab"]))
        if self.o.get("stack") == "true":
            if not 400 <= v.header.ispg <= 630 or v.header.mz <= 0:
                raise E.NotAVolumeStack(f"ispg {v.header.ispg}, mz {v.header.mz}")
            return v.header.mz
        return 1 if self.content == "blocks" else max(1, ROW_BYTES // max(1, v.shape[0] * v.shape[1] * 8))

    def read(self, partition: Sections) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.content == "headers":
            yield self._header_row(partition.path)
            return
        v = self._open(partition.path)
        begin, end = self._box(v)
        target = self.o.get("valueType") or self.o.get("valuetype") or "native"
        unsigned = is_unsigned(v, self.o)
        kind = arrow_type(self.schema["data" if self.content == "blocks" else "value"].dataType)
        step = self._step(v)
        for z in range(partition.z0, partition.z1, step):
            offset, size = (begin[0], begin[1], z), (end[0] - begin[0], end[1] - begin[1], min(step, partition.z1 - z))
            if target == "raw":
                values: pa.Array = pa.array([v.box_bytes(offset, size)], pa.binary())
            else:
                box = convert_box(v.raw_box(offset, size), v.mode, target, self.o.get("complexStrategy") or self.o.get("complexstrategy") or "magnitude", unsigned, self.o.get("rounding", "trunc"))
                values = self._values(box, v.mode, target, kind)
            yield self._batch(v.path, offset, size, values, target)

    @staticmethod
    def _values(box: np.ndarray, mode: Mode, target: str, kind: pa.DataType) -> pa.Array:
        inner = kind.value_type if pa.types.is_list(kind) else kind
        if mode.is_complex and target == "native":
            flat = box.reshape(-1, 2)
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], names=["re", "im"])
        return pa.array(np.ascontiguousarray(box).reshape(-1).astype(inner.to_pandas_dtype(), copy=False))

    def _batch(self, path: str, offset: tuple, size: tuple, values: pa.Array, target: str) -> pa.RecordBatch:
        if self.content == "voxels":
            n = len(values)
            at = np.arange(n, dtype=np.int64)
            plane = size[0] * size[1]
            axes = {"z": offset[2] + at // plane, "y": offset[1] + at % plane // size[0], "x": offset[0] + at % size[0]}
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *(pa.array(axes[a].astype(np.int32)) for a in "zyx"), values], names=["path", "z", "y", "x", "value"])
        data = values if target == "raw" else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        head = [pa.array([path], pa.string()), *(pa.array([n], pa.int32()) for n in (*offset, *size))]
        return pa.RecordBatch.from_arrays([*head, data], names=[f.name for f in self.schema.fields])

    def _header_row(self, path: str) -> pa.RecordBatch:
        """A file's row; permissive reading reports a file without a usable header by its path and the error alone."""
        from pyspark.sql.pandas.types import to_arrow_schema

        row: dict = {f.name: None for f in self.schema.fields} | {"path": path}
        try:
            v = self._open(path)
            row |= {"compression": v.compression, "endian": v.header.endian, "standard_stamp": v.header.standard_stamp, "truncated": v.truncated, "m0_unsigned": v.header.mode == 0 and v.header.imod_unsigned(), "warnings": v.warnings, "ext_header": v.extended_header(), "header": v.header.row(), "imod": imod_fields(v.header)}
        except E.VolumeError as e:
            if not self._permissive():
                raise
            row["warnings"] = [f"{e.code}: {e}"]
        return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(self.schema))


class VolumetricSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "volumetric"

    def schema(self) -> T.StructType:
        content = self.options.get("content", "blocks")
        if content == "headers":
            return HEADERS_SCHEMA
        target = self.options.get("valueType", "native")
        if target not in TARGETS:
            raise E.TypeMismatch(f"valueType {target}")
        if target == "native":
            kind = self._native_type()
        else:
            kind = value_type(mode_of(2), target)
        if content == "voxels":
            return T.StructType([T.StructField("path", T.StringType()), *(T.StructField(a, T.IntegerType()) for a in "zyx"), T.StructField("value", kind)])
        data = kind if target == "raw" else T.ArrayType(kind)
        return T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("ox", "oy", "oz", "sx", "sy", "sz")), T.StructField("data", data)])

    def _native_type(self) -> T.DataType:
        """The type of the first file that is asked for; planning compares the others with it."""
        files, modes = list_files(self.options["path"]), wanted_modes(dict(self.options))
        permissive = self.options.get("mode", "STRICT").upper() == "PERMISSIVE"
        for path in files:
            try:
                probe = peek_volume(path, self.options.get("compression", "auto"))
                if modes is None or probe.header.mode in modes:
                    return value_type(probe.mode, "native", is_unsigned(probe, dict(self.options)))
            except E.VolumeError:
                if not permissive:
                    raise
        if modes:
            return value_type(mode_of(min(modes)), "native")
        raise E.VolumeIOError("no files; name a valueType to read none")

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool):  # noqa: ANN201
        from voxlake.sources.sink import VolumeWriter

        return VolumeWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark offer filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumetricSource)


def read_blocks(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("volumetric").options(content="blocks", **options).load(path)


def read_voxels(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("volumetric").options(content="voxels", **options).load(path)


def read_headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("volumetric").options(content="headers", **options).load(path)


def read_as(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Whole volumes as voxels of one type."""
    return read_voxels(spark, path, valueType=target)


def decode_binary(rows: DataFrame, path: str = "path", content: str = "content", target: str = "float", permissive: bool = False) -> DataFrame:
    """Block rows of volumes held in a binary column (``binaryFile``, a message, a table); one section a row.

    Works with every store that Spark reads, since Spark hands over the bytes.
    """
    ship(rows.sparkSession)
    kind = VALUE_TYPES[target]
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("ox", "oy", "oz", "sx", "sy", "sz")), T.StructField("data", T.ArrayType(kind))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = arrow_type(kind)
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                v = open_volume(p, permissive, content=raw)
                nx, ny, nz = v.shape
                for z in range(nz):
                    box = convert_box(v.raw_box((0, 0, z), (nx, ny, 1)), v.mode, target, unsigned=v.header.mode == 0 and v.header.imod_unsigned())
                    values = pa.array(np.ascontiguousarray(box).reshape(-1).astype(inner.to_pandas_dtype(), copy=False), inner)
                    head = [pa.array([p], pa.string()), *(pa.array([n], pa.int32()) for n in (0, 0, z, nx, ny, 1))]
                    yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=schema.names)

    return rows.select(path, content).mapInArrow(each, schema)


def read_through_spark(spark: SparkSession, path: str, target: str = "float") -> DataFrame:
    """Block rows by way of Spark's own file reader."""
    return decode_binary(spark.read.format("binaryFile").load(path), target=target)


