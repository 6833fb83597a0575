"""Reading one volume: compression, header, byte ranges, and decoding of boxes with numpy."""

from __future__ import annotations

import bz2
import gzip
import io
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

from voxlake import errors as E
from voxlake.functions.header import ACCEPTED_MAPS, HEADER_BYTES, Header, decode_header
from voxlake.functions.modes import MODES, Mode, data_bytes, dtype, mode_of
from voxlake.functions.rules import PERMISSIVE, STRICT

#: A decompressed file may have so many bytes.
MAX_DECOMPRESSED = 256 << 30
TARGETS = ("native", "float", "half", "short", "ushort", "byte", "ubyte", "raw")
_RANGES = {"short": (np.int16, -32768, 32767), "ushort": (np.int32, 0, 65535), "byte": (np.int8, -128, 127)}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def sniff(raw: bytes) -> str:
    """gzip, bzip2 or plain, from the first two bytes."""
    return {b"\x1f\x8b": "gzip", b"BZ": "bzip2"}.get(raw[:2], "plain")


PIECE = 16 << 20


def decompressor(raw: io.IOBase, compression: str) -> io.IOBase:
    return gzip.GzipFile(fileobj=raw) if compression == "gzip" else bz2.BZ2File(raw)


def read_some(stream: io.IOBase, n: int) -> bytes:
    """n bytes of a decompressing stream, or what is left, piece by piece."""
    pieces, held = [], 0
    try:
        while held < n and (piece := stream.read(min(PIECE, n - held))):
            pieces.append(piece)
            held += len(piece)
    except (OSError, EOFError, zlib.error) as e:
        raise E.VolumeIOError(f"cannot decompress: {e}") from e
    return b"".join(pieces)


def decompressed_size(stream: io.IOBase, limit: int) -> int:
    """Bytes of the whole content, which is not held; an error beyond ``limit``."""
    size = 0
    while piece := len(read_some(stream, min(PIECE, limit + 1 - size))):
        size += piece
        if size > limit:
            raise E.VolumeIOError(f"decompressed data exceeds {limit} bytes")
    return size


def rule_values(h: Header) -> dict:
    """What the header rules read, of one header."""
    v = h.values
    used = [bool(v["labels"][80 * i : 80 * i + 80].strip(b"\0 ")) for i in range(10)]
    among = used[: max(min(v["nlabl"], 10), 0)]
    text = v["map"].decode("latin-1")
    return v | {"nversion": h.nversion, "map": text, "map_ok": text in ACCEPTED_MAPS, "mode_ok": v["mode"] in MODES, "labels_used": sum(used), "first_blank": among.index(False) if False in among else -1, "stack_rest": v["nz"] % v["mz"] if v["mz"] else 0}


def strict_problem(h: Header) -> tuple[str, str] | None:
    """The first strict header rule that fails, as (code, message)."""
    v = rule_values(h)
    return next(((code, message.format_map(v)) for code, rule, message in STRICT if not rule(v)), None)


def permissive_warnings(h: Header) -> list[str]:
    v = rule_values(h)
    return [message.format_map(v) for rule, message in PERMISSIVE if not rule(v)]


@dataclass
class Volume:
    """An opened volume. ``read(offset, n)`` gives bytes of the decompressed file."""

    path: str
    header: Header
    compression: str
    available: int
    read: object
    warnings: list[str] = field(default_factory=list)

    @property
    def mode(self) -> Mode:
        return mode_of(self.header.mode)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.header.nx, self.header.ny, self.header.nz

    @property
    def data_size(self) -> int:
        return data_bytes(*self.shape, self.mode)

    @property
    def truncated(self) -> bool:
        return self.available < self.header.data_offset + self.data_size

    def extended_header(self) -> bytes:
        return self.read(HEADER_BYTES, max(self.header.nsymbt, 0))

    def raw_box(self, offset: tuple[int, int, int], size: tuple[int, int, int]) -> np.ndarray:
        """A box as an array (z, y, x) of stored numbers in native types; complex has a last axis (re, im), nibbles are unpacked."""
        nx, ny, nz = self.shape
        if any(o < 0 or s < 0 or o + s > n for o, s, n in zip(offset, size, (nx, ny, nz), strict=True)):
            raise E.BoundsError(f"box {offset}+{size} is not inside {self.shape}")
        (ox, oy, oz), (sx, sy, sz) = offset, size
        mode = self.mode
        row = data_bytes(nx, 1, 1, mode)
        planes = []
        whole = oy == 0 and sy == ny
        for z in [oz] if whole else range(oz, oz + sz):
            n = row * ny * sz if whole else row * sy
            raw = self.read(self.header.data_offset + (z * ny + oy) * row, n)
            # what a short file lacks reads as zeros
            planes.append(raw.ljust(n, b"\0"))
        flat = np.frombuffer(b"".join(planes), dtype=dtype(mode, self.header.endian))
        if mode.code == 101:
            packed = flat.reshape(sz, sy, row)
            return np.stack([packed & 15, packed >> 4], axis=-1).reshape(sz, sy, 2 * row)[:, :, ox : ox + sx].astype(np.int8)
        if mode.is_complex:
            return flat.reshape(sz, sy, nx, 2)[:, :, ox : ox + sx].astype(np.dtype(mode.numpy))
        return flat.reshape(sz, sy, nx)[:, :, ox : ox + sx].astype(np.dtype(mode.numpy))

    def box_bytes(self, offset: tuple[int, int, int], size: tuple[int, int, int]) -> bytes:
        """The stored bytes of a box; nibbles are packed again row by row."""
        box = self.raw_box(offset, size)
        if self.mode.code == 101:
            return pack_rows(box)
        return np.ascontiguousarray(box, dtype=dtype(self.mode, self.header.endian)).tobytes()


def pack_rows(values: np.ndarray) -> bytes:
    """Rows (last axis) of voxels from 0 to 15 as packed nibbles, low nibble first; an odd row's last upper nibble is 0."""
    if values.size and (values.min() < 0 or values.max() > 15):
        raise E.ValueOutOfRange("packed voxels are 0 to 15")
    v = values.astype(np.uint8).reshape(-1, values.shape[-1])
    if v.shape[1] % 2:
        v = np.pad(v, ((0, 0), (0, 1)))
    return (v[:, ::2] | v[:, 1::2] << 4).tobytes()


def convert_box(box: np.ndarray, mode: Mode, target: str, strategy: str = "magnitude", unsigned: bool = False, rounding: str = "trunc") -> np.ndarray:
    """A box as another type: real (from complex by ``strategy``), clamped and rounded as the column functions do."""
    if target == "ubyte":
        # bytes are only taken from packed and unsigned voxels, and never clamped
        if mode.code not in (6, 101):
            raise E.ModeMismatch(f"mode {mode.code} is not read as unsigned bytes")
        if box.size and box.max() > 255:
            raise E.ValueOutOfRange(f"{box.max()} is more than 255")
        return box.astype(np.int16)
    if mode.code == 0 and unsigned:
        box = (box.astype(np.int16)) & 255
    if target in ("native", "raw"):
        return box
    if mode.is_complex:
        re, im = box[..., 0].astype(np.float32).astype(np.float64), box[..., 1].astype(np.float32).astype(np.float64)
        box = {"real": lambda: re, "imaginary": lambda: im, "magnitude": lambda: np.sqrt(re * re + im * im), "phase": lambda: np.arctan2(im, re)}[strategy]().astype(np.float32)
    if target == "float":
        return box.astype(np.float32)
    if target == "half":
        with np.errstate(over="ignore"):
            return box.astype(np.float32).astype(np.float16).astype(np.float32)
    kind, low, high = _RANGES[target]
    if np.issubdtype(box.dtype, np.integer):
        return np.clip(box.astype(np.int64), low, high).astype(kind)
    wide = np.nan_to_num(box.astype(np.float64), nan=0.0, posinf=high, neginf=low)
    wide = np.rint(wide) if rounding == "half_even" else wide
    return np.trunc(np.clip(wide, low, high)).astype(kind)


def _sources(path: str, content: bytes | None) -> tuple[io.IOBase, int]:
    if content is not None:
        return io.BytesIO(content), len(content)
    fs, local = open_fs(path)
    source = fs.open_input_file(local)
    return source, source.size()


def peek_volume(path: str, compression: str = "auto") -> Volume:
    """Only the header, for planning: a compressed file is not decompressed any further."""
    source, size = _sources(path, None)
    first = source.read(2)
    source.seek(0)
    kind = sniff(first) if compression == "auto" else {"none": "plain"}.get(compression, compression)
    raw = source.read(HEADER_BYTES) if kind == "plain" else read_some(decompressor(source, kind), HEADER_BYTES)
    return Volume(path, decode_header(raw), kind, size, None)


def open_volume(path: str, permissive: bool = False, compression: str = "auto", limit: int = MAX_DECOMPRESSED, content: bytes | None = None) -> Volume:
    """Open a file, or the bytes in ``content``; compression is recognised in either.

    A compressed file is passed through once for its size and again, forwards, for what is
    read from it; it is never held whole.
    """
    source, size = _sources(path, content)
    first = source.read(2)
    source.seek(0)
    kind = sniff(first) if compression == "auto" else {"none": "plain"}.get(compression, compression)
    stream = source
    if kind != "plain":
        size = decompressed_size(decompressor(source, kind), limit)
        source.seek(0)
        stream = decompressor(source, kind)

    def read(offset: int, n: int) -> bytes:
        if offset >= size or n <= 0:
            return b""
        stream.seek(offset)
        return read_some(stream, min(n, size - offset))

    h = decode_header(read(0, HEADER_BYTES))
    problem = strict_problem(h)
    warnings = list(h.warnings)
    if problem and (not permissive or problem[0] in ("InvalidDimensions", "UnsupportedMode")):
        raise E.UnsupportedMode(f"mode {h.mode}") if problem[0] == "UnsupportedMode" else E.InvalidHeaderDetailed(*problem)
    if permissive:
        warnings += permissive_warnings(h)
    if h.mode == 0 and h.imod_unsigned():
        warnings.append("mode 0 is unsigned by its IMOD stamp")
    out = Volume(path, h, kind, size, read, warnings)
    if not permissive and size != h.data_offset + out.data_size:
        raise E.FileSizeMismatch(f"{size} bytes instead of {h.data_offset + out.data_size}")
    return out


def read_array(path: str, target: str = "native", **options) -> np.ndarray:
    """A whole volume as one array (nz, ny, nx) in this process."""
    v = open_volume(path, **options)
    unsigned = v.header.mode == 0 and v.header.imod_unsigned()
    return convert_box(v.raw_box((0, 0, 0), v.shape), v.mode, target, unsigned=unsigned)
