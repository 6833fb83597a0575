"""The 1024-byte header: layout, byte order, codec, and column functions over its fields."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.errors import InvalidHeader
from voxlake.functions.modes import MODES

HEADER_BYTES = 1024
#: Fixed layout: name, numpy type without byte order.
LAYOUT = [
    *((n, "i4") for n in ("nx", "ny", "nz", "mode", "nxstart", "nystart", "nzstart", "mx", "my", "mz")),
    *((n, "f4") for n in ("xlen", "ylen", "zlen", "alpha", "beta", "gamma")),
    *((n, "i4") for n in ("mapc", "mapr", "maps")),
    *((n, "f4") for n in ("dmin", "dmax", "dmean")),
    ("ispg", "i4"),
    ("nsymbt", "i4"),
    ("extra", "V100"),
    ("origin", ("f4", 3)),
    ("map", "V4"),
    ("machst", "V4"),
    ("rms", "f4"),
    ("nlabl", "i4"),
    ("labels", "V800"),
]
NUMBERS = [n for n, t in LAYOUT if t in ("i4", "f4")]
_KINDS = {"i4": T.IntegerType(), "f4": T.FloatType()}
HEADER_TYPE = T.StructType(
    [T.StructField(n, _KINDS[t]) for n, t in LAYOUT if t in _KINDS]
    + [
        T.StructField("extra", T.BinaryType()),
        T.StructField("origin", T.ArrayType(T.FloatType())),
        T.StructField("map", T.StringType()),
        T.StructField("machst", T.BinaryType()),
        T.StructField("label_raw", T.BinaryType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("exttyp", T.StringType()),
        T.StructField("nversion", T.IntegerType()),
    ]
)
DEFAULTS = {"mode": 2, "xlen": 1.0, "ylen": 1.0, "zlen": 1.0, "alpha": 90.0, "beta": 90.0, "gamma": 90.0, "mapc": 1, "mapr": 2, "maps": 3, "dmin": 0.0, "dmax": -1.0, "dmean": -2.0, "ispg": 1, "rms": -1.0}
VERSION = 20141


def _dtype(endian: str) -> np.dtype:
    o = "<" if endian == "little" else ">"
    return np.dtype([(n, (o + t[0], t[1]) if isinstance(t, tuple) else (t if t[0] == "V" else o + t)) for n, t in LAYOUT])


def stamp_endian(stamp: bytes) -> tuple[str, bool]:
    """Byte order that a machine stamp tells, and whether the stamp is a standard one."""
    if stamp[:2] == b"\x44\x44":
        return "little", True
    if stamp[:2] == b"\x44\x41":
        return "little", False
    if stamp[:2] == b"\x11\x11":
        return "big", True
    return "little", False


def endian_stamp(endian: str) -> bytes:
    return b"\x44\x44\x00\x00" if endian == "little" else b"\x11\x11\x00\x00"


@dataclass
class Header:
    """Field values with the byte order that they were decoded in."""

    values: dict = field(default_factory=dict)
    endian: str = "little"
    standard_stamp: bool = True
    swapped: bool = False

    def __getattr__(self, name: str):  # noqa: ANN204
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def exttyp(self) -> bytes:
        return self.values["extra"][8:12]

    @property
    def nversion(self) -> int:
        return int.from_bytes(self.values["extra"][12:16], self.endian, signed=True)

    @property
    def data_offset(self) -> int:
        return HEADER_BYTES + max(self.values["nsymbt"], 0)

    @property
    def warnings(self) -> list[str]:
        if self.swapped:
            return [f"MACHST contradicts MODE; the header was decoded as {self.endian}-endian"]
        return [] if self.standard_stamp else [f"non-standard MACHST; {self.endian}-endian is assumed"]

    def imod_stamped(self) -> bool:
        return self.values["extra"][56:60] == b"IMOD"

    def imod_unsigned(self) -> bool:
        """Mode 0 is unsigned where the stamp is there and its flag's lowest bit is not set."""
        return self.imod_stamped() and not self.values["extra"][60] & 1

    def row(self) -> dict:
        """As a value of HEADER_TYPE."""
        v = self.values
        raw = v["labels"]
        out = {n: v[n] for n in NUMBERS}
        out |= {"extra": v["extra"], "origin": list(v["origin"]), "map": v["map"].decode("latin-1"), "machst": v["machst"], "label_raw": raw}
        return out | {"labels": label_list(raw, v["nlabl"]), "exttyp": self.exttyp.decode("latin-1"), "nversion": self.nversion}


def label_list(raw: bytes, nlabl: int) -> list[str]:
    """The first nlabl labels, white space trimmed at the end (NULs are not)."""
    return [raw[80 * i : 80 * i + 80].decode("utf-8", "replace").rstrip() for i in range(min(max(nlabl, 0), 10))]


def decode_header(raw: bytes) -> Header:
    """Decode; where MODE is invalid in the stamp's byte order and valid in the other, the other is used throughout."""
    if len(raw) < HEADER_BYTES:
        raise InvalidHeader(f"{len(raw)} bytes are less than a header")
    endian, standard = stamp_endian(raw[212:216])
    other = "big" if endian == "little" else "little"
    swapped = False
    if int.from_bytes(raw[12:16], endian, signed=True) not in MODES and int.from_bytes(raw[12:16], other, signed=True) in MODES:
        endian, swapped = other, True
    rec = np.frombuffer(raw, dtype=_dtype(endian), count=1)[0]
    values = {n: rec[n].tobytes() if t[0] == "V" else (tuple(float(x) for x in rec[n]) if isinstance(t, tuple) else rec[n].item()) for n, t in LAYOUT}
    return Header(values, endian, standard, swapped)


def encode_header(h: Header) -> bytes:
    rec = np.zeros(1, dtype=_dtype(h.endian))
    for n, t in LAYOUT:
        rec[n] = np.void(h.values[n]) if t[0] == "V" else h.values[n]
    return rec.tobytes()


def new_header(nx: int = 0, ny: int = 0, nz: int = 0, mode: int = 2, **fields) -> Header:
    """A little-endian header with the format's defaults; the sampling equals the shape."""
    extra = bytearray(100)
    extra[12:16] = VERSION.to_bytes(4, "little")
    values = {n: DEFAULTS.get(n, 0) for n in NUMBERS}
    values |= {"nx": nx, "ny": ny, "nz": nz, "mode": mode, "mx": nx, "my": ny, "mz": nz, "extra": bytes(extra), "origin": (0.0, 0.0, 0.0), "map": b"MAP ", "machst": endian_stamp("little"), "labels": bytes(800)}
    return Header(values | fields)


def set_endian(h: Header, endian: str) -> Header:
    """The header for a file of that byte order: its stamp and its version number are written anew."""
    extra = bytearray(h.values["extra"])
    extra[12:16] = h.nversion.to_bytes(4, endian, signed=True)
    return Header(h.values | {"machst": endian_stamp(endian), "extra": bytes(extra)}, endian)


def with_extra(h: Header, at: int, raw: bytes) -> Header:
    extra = bytearray(h.values["extra"])
    extra[at : at + len(raw)] = raw
    return Header(h.values | {"extra": bytes(extra)}, h.endian, h.standard_stamp, h.swapped)


def add_label(h: Header, text: str) -> Header:
    """Put a label in the first empty slot; if all ten are used, the oldest goes. Non-printable characters become spaces."""
    clean = "".join(c if " " <= c <= "~" else " " for c in text)[:80].ljust(80).encode()
    slots = [h.values["labels"][80 * i : 80 * i + 80] for i in range(10)]
    blank = [not s.strip(b"\0 ") for s in slots]
    if True in blank:
        slots[blank.index(True)] = clean
    else:
        slots = [*slots[1:], clean]
    used = sum(bool(s.strip(b"\0 ")) for s in slots)
    return Header(h.values | {"labels": b"".join(slots), "nlabl": used}, h.endian, h.standard_stamp, h.swapped)


def imod_fields(h: Header) -> dict | None:
    """Metadata of the IMOD stamp (little-endian wherever the header is); null without the stamp. Its origin and cell overlap EXTTYP."""
    if not h.imod_stamped():
        return None
    e = h.values["extra"]
    i16 = lambda at: int.from_bytes(e[at : at + 2], "little", signed=True)
    f3 = lambda at: [float(x) for x in np.frombuffer(e, "<f4", 3, at)]
    kinds = ["Mono", "Tilt", "Tilts", "Lina", "Lins"]
    kind = i16(64)
    return {
        "flags": int.from_bytes(e[60:62], "little"), "type": kinds[kind] if 0 <= kind < 5 else "Mono", "tilt_axis": min(max(i16(68), 1), 3),
        "tilt_increment": i16(72) / 100, "start_angle": i16(74) / 100, "original_angles": f3(76), "current_angles": f3(88), "origin": f3(0), "cell": f3(12),
    }


_TRIPLE = T.ArrayType(T.DoubleType())
IMOD_TYPE = T.StructType(
    [T.StructField("flags", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("tilt_axis", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("tilt_increment", "start_angle")]
    + [T.StructField(n, _TRIPLE) for n in ("original_angles", "current_angles", "origin", "cell")]
)

# column functions


def voxel_size(length: Column, sampling: Column) -> Column:
    return F.when(sampling == 0, F.lit(0.0)).otherwise(length.cast("double") / sampling)


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Volume of a triclinic cell; 0 if a length is not positive."""
    ca, cb, cg = (F.cos(F.radians(x.cast("double"))) for x in (alpha, beta, gamma))
    root = F.sqrt(F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(0.0)))
    return F.when((a <= 0) | (b <= 0) | (c <= 0), F.lit(0.0)).otherwise(a.cast("double") * b.cast("double") * c.cast("double") * root)


def header_tuples(h: Column) -> Column:
    """nstart, cell lengths and angles, sampling and density statistics of a header column, as arrays."""
    groups = {"nstart": ("nxstart", "nystart", "nzstart"), "cell_lengths": ("xlen", "ylen", "zlen"), "cell_angles": ("alpha", "beta", "gamma"), "sampling": ("mx", "my", "mz"), "density_stats": ("dmin", "dmax", "dmean", "rms")}
    return F.struct(*(F.array(*(h.getField(n) for n in names)).alias(g) for g, names in groups.items()))


def header_json(h: Column) -> Column:
    """A header column as JSON; ``F.from_json(text, HEADER_TYPE)`` reads it back."""
    return F.to_json(h)


def is_volume_stack(ispg: Column) -> Column:
    return ispg.between(400, 630)


def is_image_stack(ispg: Column) -> Column:
    return ispg == 0


def is_volume(ispg: Column) -> Column:
    return ~is_volume_stack(ispg) & ~is_image_stack(ispg)


def is_single_image(nz: Column) -> Column:
    return nz == 1


def volume_kind(nz: Column, ispg: Column) -> Column:
    """Single image, then image stack, then volume stack, else volume."""
    return F.when(is_single_image(nz), "single image").when(is_image_stack(ispg), "image stack").when(is_volume_stack(ispg), "volume stack").otherwise("volume")


def logical_shape(nx: Column, ny: Column, nz: Column, mz: Column, ispg: Column) -> Column:
    """[volumes, sections, rows, columns]."""
    stack = F.when(mz > 0, F.array(F.floor(nz / mz).cast("int"), mz, ny, nx)).otherwise(F.array(F.lit(0), F.lit(0), ny, nx))
    return F.when(is_volume_stack(ispg), stack).otherwise(F.array(F.lit(1), nz, ny, nx))


def data_offset(nsymbt: Column) -> Column:
    return (F.lit(HEADER_BYTES) + F.greatest(nsymbt, F.lit(0))).cast("long")


def is_y_inverted(mapr: Column) -> Column:
    return mapr == -2


ACCEPTED_MAPS = ("MAP ", "MAP\0", "MAPI", "\0\0\0\0")


def is_standard_map(map_field: Column) -> Column:
    return map_field == "MAP "


def accepted_map(map_field: Column) -> Column:
    return map_field.isin(*ACCEPTED_MAPS)


def label_text(label: Column) -> Column:
    """A label without white space at its end."""
    return F.regexp_replace(label, r"\s+$", "")


def label_blank(label: Column) -> Column:
    """Only NULs and spaces."""
    return F.regexp_replace(label, "[ \\x00]", "") == ""


def machst_endian(stamp_hex: Column) -> tuple[Column, Column]:
    """(endian, is_standard) of a stamp in hexadecimal."""
    two = F.upper(F.substring(stamp_hex, 1, 4))
    return F.when(two == "1111", "big").otherwise("little"), two.isin("4444", "1111")


def detect_compression(raw: Column) -> Column:
    """gzip, bzip2 or plain, from the first bytes of a binary column."""
    magic = F.hex(F.substring(raw, 1, 2))
    return F.when(magic == "1F8B", "gzip").when(magic == "425A", "bzip2").otherwise("plain")
