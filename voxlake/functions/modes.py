"""The eight voxel modes: sizes, kinds, numpy and Spark types."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.errors import UnsupportedMode


@dataclass(frozen=True)
class Mode:
    code: int
    name: str
    size: int
    numpy: str
    spark: T.DataType
    is_complex: bool = False
    is_integer: bool = False
    is_float: bool = False


def _pair(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("re", kind), T.StructField("im", kind)])


#: Fixed values of the format. Complex integers and packed nibbles count as integers, complex floats as floats.
MODES = {
    m.code: m
    for m in (
        Mode(0, "Int8", 1, "i1", T.ByteType(), is_integer=True),
        Mode(1, "Int16", 2, "i2", T.ShortType(), is_integer=True),
        Mode(2, "Float32", 4, "f4", T.FloatType(), is_float=True),
        Mode(3, "Int16Complex", 4, "i2", _pair(T.ShortType()), is_complex=True, is_integer=True),
        Mode(4, "Float32Complex", 8, "f4", _pair(T.FloatType()), is_complex=True, is_float=True),
        Mode(6, "Uint16", 2, "u2", T.IntegerType(), is_integer=True),
        Mode(12, "Float16", 2, "f2", T.FloatType(), is_float=True),
        Mode(101, "Packed4Bit", 1, "u1", T.ByteType(), is_integer=True),
    )
}


def mode_of(code: int) -> Mode:
    if code not in MODES:
        raise UnsupportedMode(f"mode {code}")
    return MODES[code]


def dtype(mode: Mode, endian: str) -> np.dtype:
    """numpy type of a stored number; ``endian`` is 'little' or 'big'."""
    return np.dtype(("<" if endian == "little" else ">") + mode.numpy)


def bytes_for(mode: Mode, count: int) -> int:
    """Bytes of ``count`` voxels in a row; packed nibbles share bytes."""
    return (count + 1) // 2 if mode.code == 101 else count * mode.size


def data_bytes(nx: int, ny: int, nz: int, mode: Mode) -> int:
    """Bytes of a volume's data; negative dimensions count as 0."""
    nx, ny, nz = max(nx, 0), max(ny, 0), max(nz, 0)
    return bytes_for(mode, nx) * ny * nz


def _case(code: Column, pick) -> Column:  # noqa: ANN001
    out = F.lit(None)
    for m in MODES.values():
        out = F.when(code == m.code, F.lit(pick(m))).otherwise(out)
    return out


def mode_name(code: Column) -> Column:
    return _case(code, lambda m: m.name)


def mode_byte_size(code: Column) -> Column:
    """Bytes of a voxel (1 for packed nibbles); null for unknown modes."""
    return _case(code, lambda m: m.size)


def mode_bytes_for_count(code: Column, count: Column) -> Column:
    return F.when(code == 101, F.floor((count + 1) / 2)).otherwise(mode_byte_size(code) * count).cast("long")


def mode_is_complex(code: Column) -> Column:
    return _case(code, lambda m: m.is_complex)


def mode_is_integer(code: Column) -> Column:
    return _case(code, lambda m: m.is_integer)


def mode_is_float(code: Column) -> Column:
    return _case(code, lambda m: m.is_float)


def data_size(nx: Column, ny: Column, nz: Column, code: Column) -> Column:
    """Bytes of the data block: null for unknown modes and on overflow."""
    x, y, z = (F.greatest(c.cast("long"), F.lit(0).cast("long")) for c in (nx, ny, nz))
    row = mode_bytes_for_count(code, x)
    return F.try_multiply(F.try_multiply(row, y), z)
