"""Voxel conversions as column functions; all run inside generated code unless they say otherwise.

Each takes and returns columns, so it applies to long form (a row a voxel) and, through
``over_block``, to the arrays of block rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from voxlake.errors import TypeMismatch

RANGES = {"byte": (-128, 127), "short": (-32768, 32767), "ushort": (0, 65535), "ubyte": (0, 255)}
SPARK_TYPES = {"byte": "tinyint", "short": "smallint", "ushort": "int", "ubyte": "smallint", "float": "float", "half": "float"}


def over_block(data: Column, f: Callable[[Column], Column]) -> Column:
    """Apply a conversion to every voxel of a block's array."""
    return F.transform(data, lambda v: f(v))


def to_float(v: Column) -> Column:
    """Integers and half floats widen exactly."""
    return v.cast("float")


def narrow_float(v: Column, target: str, rounding: str = "trunc") -> Column:
    """Float to an integer type: NaN is 0, values are clamped, fractions go towards zero or (``half_even``) to the nearest even."""
    low, high = RANGES[target]
    d = v.cast("double")
    d = F.rint(d) if rounding == "half_even" else d
    inside = F.least(F.greatest(d, F.lit(float(low))), F.lit(float(high)))
    return F.when(F.isnan(d), F.lit(0).cast(SPARK_TYPES[target])).when(d.isNotNull(), inside.cast(SPARK_TYPES[target]))


def float_to_i16(v: Column, rounding: str = "trunc") -> Column:
    return narrow_float(v, "short", rounding)


def float_to_u16(v: Column, rounding: str = "trunc") -> Column:
    return narrow_float(v, "ushort", rounding)


def float_to_i8(v: Column, rounding: str = "trunc") -> Column:
    return narrow_float(v, "byte", rounding)


def clamp_int(v: Column, target: str) -> Column:
    """Integer to integer with clamping, without a float between."""
    low, high = RANGES[target]
    return F.when(v.isNotNull(), F.least(F.greatest(v.cast("int"), F.lit(low)), F.lit(high)).cast(SPARK_TYPES[target]))


@pandas_udf(T.FloatType())
def float_to_f16(v: pd.Series) -> pd.Series:
    """Round to half precision (nearest even), kept in a float column; Arrow batches."""
    with np.errstate(over="ignore"):
        return pd.Series(v.to_numpy(np.float32, na_value=np.nan).astype(np.float16).astype(np.float32)).where(v.notna().to_numpy(), None)


def complex_to_real(re: Column, im: Column, strategy: str = "magnitude") -> Column:
    """Real part, imaginary part, magnitude or phase; parts are floats first."""
    re, im = re.cast("float").cast("double"), im.cast("float").cast("double")
    return {
        "real": lambda: re,
        "imaginary": lambda: im,
        "magnitude": lambda: F.sqrt(re * re + im * im),
        "phase": lambda: F.atan2(im, re),
    }[strategy]().cast("float")


def reinterpret_mode0(v: Column, unsigned: Column | bool) -> Column:
    """A stored byte as signed or unsigned."""
    b = v.cast("int").bitwiseAND(255)
    signed = F.when(b >= 128, b - 256).otherwise(b)
    flag = unsigned if isinstance(unsigned, Column) else F.lit(unsigned)
    return F.when(flag, b).otherwise(signed)


def nibbles(byte: Column) -> tuple[Column, Column]:
    """The two voxels of a packed byte, low nibble first."""
    b = byte.cast("int").bitwiseAND(255)
    return b.bitwiseAND(15), F.shiftright(b, 4)


def unpack_nibble(byte: Column, x: Column) -> Column:
    """Voxel x of a row from its byte x div 2."""
    low, high = nibbles(byte)
    return F.when(x % 2 == 0, low).otherwise(high).cast("tinyint")


def pack_nibbles(low: Column, high: Column) -> Column:
    """A packed byte; a missing upper voxel is 0. Values above 15 are an error."""
    bad = F.raise_error(F.lit("ValueOutOfRange: packed voxels are 0 to 15")).cast("int")
    low, high = (F.when((v < 0) | (v > 15), bad).otherwise(v.cast("int")) for v in (low, high))
    return F.shiftleft(F.coalesce(high, F.lit(0)), 4).bitwiseOR(low)


def u16_to_u8(v: Column, checked: bool = True) -> Column:
    """Narrow; a value above 255 is an error, or null if not ``checked``."""
    bad = F.raise_error(F.lit("ValueOutOfRange: 8-bit voxels are 0 to 255")) if checked else F.lit(None)
    return F.when((v > 255) | (v < 0), bad.cast("smallint")).otherwise(v.cast("smallint"))


def u8_to_u16(v: Column) -> Column:
    return v.cast("int")


def stored_int(raw: Column, index: Column, width: int, endian: str, signed: bool) -> Column:
    """Integer ``index`` (from 0) of a binary column of numbers ``width`` bytes wide."""
    at = index * width
    parts = []
    for k in range(width):
        place = k if endian == "big" else width - 1 - k
        parts.append(F.hex(F.substring(raw, at + 1 + place, F.lit(1))))
    value = F.conv(F.concat(*parts), 16, 10).cast("long")
    top = 1 << (8 * width - 1)
    return F.when(value >= top, value - 2 * top).otherwise(value) if signed else value


def stored_ints(raw: Column, width: int, endian: str, signed: bool) -> Column:
    """All integers of a binary column, decoded a batch at a time; bytes beyond the last whole one are left out."""
    kind = np.dtype(f"{'>' if endian == 'big' else '<'}{'i' if signed else 'u'}{width}")
    out = T.IntegerType() if width < 4 or (width == 4 and signed) else T.LongType()
    native = np.int32 if isinstance(out, T.IntegerType) else np.int64

    @pandas_udf(T.ArrayType(out))
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else np.frombuffer(r, kind, len(r) // width).astype(native) for r in rows])

    return decode(raw)


@pandas_udf(T.BinaryType())
def swap_bytes(raw: pd.Series, width: pd.Series) -> pd.Series:
    """Reverse the bytes of every element; a length that is no multiple of the width is an error."""

    def one(r: bytes | None, w: int) -> bytes | None:
        if r is None:
            return None
        if len(r) % w:
            raise TypeMismatch("length is no multiple of the element's size")
        return np.frombuffer(r, dtype=np.uint8).reshape(-1, w)[:, ::-1].tobytes()

    return pd.Series([one(r, int(w)) for r, w in zip(raw, width, strict=True)])
