"""Region selection over voxels (path?, z, y, x, value) and block rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.errors import BlockShapeMismatch, BoundsError, NotAVolumeStack


@dataclass(frozen=True)
class Shape:
    """A volume's dimensions; x is fastest."""

    nx: int
    ny: int
    nz: int

    @property
    def total(self) -> int:
        return self.nx * self.ny * self.nz

    @property
    def is_empty(self) -> bool:
        return self.total == 0

    def contains(self, offset: tuple[int, int, int], shape: tuple[int, int, int]) -> bool:
        return all(o >= 0 and s >= 0 and o + s <= n for o, s, n in zip(offset, shape, (self.nx, self.ny, self.nz), strict=True))

    def check(self, offset: tuple[int, int, int], shape: tuple[int, int, int]) -> None:
        if not self.contains(offset, shape):
            raise BoundsError(f"box {offset}+{shape} is not inside {(self.nx, self.ny, self.nz)}")

    def is_full(self, offset: tuple[int, int, int], shape: tuple[int, int, int]) -> bool:
        return offset == (0, 0, 0) and shape == (self.nx, self.ny, self.nz)

    def linear(self, x: int, y: int, z: int) -> int | None:
        """Index of a voxel; None outside."""
        return x + y * self.nx + z * self.nx * self.ny if self.contains((x, y, z), (1, 1, 1)) else None


def check_block(shape: tuple[int, int, int], n_values: int) -> None:
    if shape[0] * shape[1] * shape[2] != n_values:
        raise BlockShapeMismatch(f"shape {shape} needs {shape[0] * shape[1] * shape[2]} values, not {n_values}")


def linear_index(x: Column, y: Column, z: Column, nx: int | Column, ny: int | Column) -> Column:
    """x + y nx + z nx ny as a long; null on overflow."""
    nx, ny = (F.lit(n).cast("long") if isinstance(n, int) else n.cast("long") for n in (nx, ny))
    plane = F.try_multiply(z.cast("long"), F.try_multiply(nx, ny))
    return F.try_add(F.try_add(x.cast("long"), F.try_multiply(y.cast("long"), nx)), plane)


def _int_div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n).cast("int")


def slices(voxels: DataFrame) -> DataFrame:
    """Adds ``slice``: one plane a region."""
    return voxels.withColumn("slice", F.col("z"))


def slabs(voxels: DataFrame, k: int, nz: int) -> DataFrame:
    """Adds ``slab``, ``z0`` and ``sz``: k planes a region, the last one short; k below 1 is 1."""
    k = max(k, 1)
    slab = _int_div("z", k)
    return voxels.withColumns({"slab": slab, "z0": slab * k, "sz": F.least(F.lit(k), F.lit(nz) - slab * k)})


def tiles(voxels: DataFrame, size: tuple[int, int, int], shape: Shape) -> DataFrame:
    """Adds tx ty tz, the tile's offset ox oy oz and its size sx sy sz, clipped at the edges."""
    if min(size) < 1:
        raise BoundsError(f"tile size {size}")
    out = voxels
    for a, c, n in zip("xyz", size, (shape.nx, shape.ny, shape.nz), strict=True):
        t = _int_div(a, c)
        out = out.withColumns({f"t{a}": t, f"o{a}": t * c, f"s{a}": F.least(F.lit(c), F.lit(n) - t * c)})
    return out


def sub_volumes(voxels: DataFrame, mz: int, ispg: int) -> DataFrame:
    """Adds ``vol``, the volume of a stack that a voxel lies in."""
    if not 400 <= ispg <= 630 or mz <= 0:
        raise NotAVolumeStack(f"ispg {ispg}, mz {mz}")
    return voxels.withColumn("vol", _int_div("z", mz))


def subregion(voxels: DataFrame, offset: tuple[int, int, int], size: tuple[int, int, int], shape: Shape) -> DataFrame:
    """The voxels of a box; plain comparisons, so a source can prune by them."""
    shape.check(offset, size)
    keep = F.lit(True)
    for a, o, s in zip("zyx", offset[::-1], size[::-1], strict=True):
        keep = keep & (F.col(a) >= o) & (F.col(a) < o + s)
    return voxels.where(keep)


def region_counts(shape: Shape, k: int, tile: tuple[int, int, int], mz: int) -> dict[str, int]:
    """Numbers of slices, slabs, tiles and sub-volumes."""
    up = lambda a, b: -(-a // b)
    return {"n_slices": shape.nz, "n_slabs": up(shape.nz, max(k, 1)), "n_tiles": up(shape.nx, tile[0]) * up(shape.ny, tile[1]) * up(shape.nz, tile[2]), "n_volumes": up(shape.nz, mz)}


def crop_blocks(blocks: DataFrame, offset: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Cut block rows to a box: rows outside go, and the arrays are sliced row by row of voxels."""
    out = blocks
    for a, o, s in zip("xyz", offset, size, strict=True):
        out = out.where((F.col(f"o{a}") < o + s) & (F.col(f"o{a}") + F.col(f"s{a}") > o))
    # the cut's begin and size get columns of their own: names inside a lambda must not be redefined beside it
    for a, o, s in zip("xyz", offset, size, strict=True):
        low = F.greatest(F.lit(o) - F.col(f"o{a}"), F.lit(0))
        out = out.withColumns({f"_b{a}": low, f"_n{a}": F.least(F.lit(o + s) - F.col(f"o{a}"), F.col(f"s{a}")) - low})
    b, n = ({a: F.col(f"_{k}{a}") for a in "xyz"} for k in "bn")
    rows = F.transform(
        F.sequence(b["z"], b["z"] + n["z"] - 1),
        lambda z: F.flatten(F.transform(F.sequence(b["y"], b["y"] + n["y"] - 1), lambda y: F.slice("data", (z * F.col("sy") + y) * F.col("sx") + b["x"] + 1, n["x"]))),
    )
    out = out.withColumn("data", F.flatten(rows))
    out = out.withColumns({f"o{a}": F.col(f"o{a}") + b[a] for a in "xyz"} | {f"s{a}": n[a] for a in "xyz"})
    return out.drop(*(f"_{k}{a}" for k in "bn" for a in "xyz"))


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """Long form (path, z, y, x, value) of block rows."""
    at = F.col("pos")
    long = blocks.select("path", "ox", "oy", "oz", "sx", "sy", F.posexplode("data").alias("pos", "value"))
    plane = F.col("sx") * F.col("sy")
    return long.select("path", (F.col("oz") + F.floor(at / plane)).cast("int").alias("z"), (F.col("oy") + F.floor(at % plane / F.col("sx"))).cast("int").alias("y"), (F.col("ox") + at % F.col("sx")).cast("int").alias("x"), "value")


def downsample(voxels: DataFrame, factor: int) -> DataFrame:
    """Mean of blocks of factor voxels a side (``rescale --down``)."""
    keys = [_int_div(a, factor).alias(a) for a in "zyx"]
    return voxels.groupBy(*keys).agg(F.avg(F.col("value").cast("double")).alias("value"))


def section_blocks(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    """Block rows of one whole section each from voxels (path, z, y, x, value); a section's voxels meet in one group."""
    cell = F.struct(linear_index(F.col("x"), F.col("y"), F.lit(0), nx, ny).alias("i"), F.col("value"))
    grouped = voxels.groupBy("path", F.col("z").alias("oz")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["value"]).alias("data"))
    zero, one = F.lit(0), F.lit(1)
    return grouped.select("path", zero.alias("ox"), zero.alias("oy"), "oz", F.lit(nx).alias("sx"), F.lit(ny).alias("sy"), one.alias("sz"), "data")
