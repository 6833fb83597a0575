"""What the companion command line offers, as DataFrame functions: info, validate, stats, convert, slice, crop, unstack, rescale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import errors as E
from voxlake.functions.header import volume_kind
from voxlake.functions.modes import mode_name, mode_of
from voxlake.operators.regions import downsample
from voxlake.operators.stats import block_moments, complex_stats, is_close, merged_stats
from voxlake.operators.validate import data_issues, header_issues
from voxlake.sources.sink import VolumeBuilder, write_volume
from voxlake.sources.volumetric import read_blocks, read_headers, read_voxels


#: Voxel modes as the reader's option names them.
REAL_MODES, COMPLEX_MODES = "0,1,2,6,12,101", ("3", "4")


def info(spark: SparkSession, path: str) -> DataFrame:
    h = read_headers(spark, path, mode="PERMISSIVE")
    c = lambda n: F.col(f"header.{n}")
    return h.select("path", "compression", "endian", c("nx"), c("ny"), c("nz"), mode_name(c("mode")).alias("voxels"), volume_kind(c("nz"), c("ispg")).alias("kind"), c("exttyp"), c("labels"), "truncated", "warnings")


def _flat(spark: SparkSession, path: str, permissive: bool) -> DataFrame:
    h = read_headers(spark, path, mode="PERMISSIVE" if permissive else "STRICT")
    label = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.substring(F.decode(F.col("label_raw"), "ISO-8859-1"), i * 80 + 1, F.lit(80)))
    return h.select("path", "endian", "standard_stamp", "warnings", "header.*").withColumn("labels", label)


def _values(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, value) of all voxels: arrays cross from Python, and are exploded inside the JVM."""
    return read_blocks(spark, path, **options).select("path", F.explode("data").alias("value"))


def _pairs(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, re, im) of the voxels of all complex files."""
    out = [_values(spark, path, modes=m, **options).select("path", F.col("value.re").cast("float").alias("re"), F.col("value.im").cast("float").alias("im")) for m in COMPLEX_MODES]
    return out[0].unionByName(out[1])


def validate(spark: SparkSession, path: str, permissive: bool = True) -> DataFrame:
    """Issues (path, severity, category, message) of all files, of real and complex voxels: headers, then statistics and values."""
    mode = "PERMISSIVE" if permissive else "STRICT"
    real = _values(spark, path, mode=mode, valueType="float", modes=REAL_MODES).select("path", F.col("value").alias("re"), F.lit(None).cast("float").alias("im"))
    volumes = _flat(spark, path, permissive)
    return header_issues(volumes).unionByName(data_issues(volumes, real.unionByName(_pairs(spark, path, mode=mode))))


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Density statistics of all real volumes, a row a file: moments of each block, taken beside the read, then merged."""
    return merged_stats(block_moments(read_blocks(spark, path, valueType="float", modes=REAL_MODES)))


def stats_complex(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all complex volumes, a row a file."""
    return _pairs(spark, path).groupBy("path").agg(*complex_stats(F.col("re"), F.col("im")))


def header(spark: SparkSession, path: str) -> DataFrame:
    """Each file's header fields by name, as rows (path, field, value)."""
    h = read_headers(spark, path, mode="PERMISSIVE")
    fields = [f.name for f in h.schema["header"].dataType.fields if f.name not in ("extra", "label_raw")]
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"header.{f}").cast("string").alias("value")) for f in fields)))
    return h.select("path", named.alias("f")).select("path", "f.*")


def check_stats(spark: SparkSession, path: str) -> None:
    """Raise StatsMismatch if a real file's header states other statistics than its voxels have; unset ones pass."""
    h = read_headers(spark, path).select("path", *(F.col(f"header.{c}").alias(f"h_{c}") for c in ("dmin", "dmax", "dmean", "rms")))
    both = h.join(stats(spark, path), "path")
    c = lambda n: F.col(f"h_{n}").cast("double")
    unset = {n: c("dmin") > c("dmax") for n in ("dmin", "dmax", "dmean")} | {"rms": c("rms") < 0}
    wrong = F.concat_ws(", ", *(F.when(~(unset[n] | is_close(c(n), F.col(n).cast("double"))), F.lit(n)) for n in unset))
    bad = both.select("path", wrong.alias("wrong")).where("wrong <> ''").first()
    if bad:
        raise E.StatsMismatch(f"{bad['path']}: {bad['wrong']}")


def convert(spark: SparkSession, path: str, folder: str, mode: int, compression: str = "none") -> None:
    """Write each real volume at the path anew in another real mode, with its cell, origin and labels."""
    heads = read_headers(spark, path).select("path", "header.*").where(F.col("mode").isin([int(m) for m in REAL_MODES.split(",")]))
    for r in heads.toLocalIterator():
        n, three = r.asDict(), lambda *k: tuple(r[x] for x in k)
        b = VolumeBuilder(three("nx", "ny", "nz"), mode, three("xlen", "ylen", "zlen"), three("alpha", "beta", "gamma"), n["ispg"], three("mx", "my", "mz"), tuple(n["origin"]), three("nxstart", "nystart", "nzstart"), three("mapc", "mapr", "maps"), labels=tuple(n["labels"]))
        as_is = mode_of(n["mode"]).code == mode
        write_volume(read_blocks(spark, r["path"], **({} if as_is else {"valueType": "float"})), folder, b, compression)


def one_slice(spark: SparkSession, path: str, z: int) -> DataFrame:
    return read_voxels(spark, path, valueType="float").where(F.col("z") == z)


def crop(spark: SparkSession, path: str, offset: tuple[int, int, int], size: tuple[int, int, int], folder: str) -> None:
    """Write a box of every volume at the path as new float volumes."""
    blocks = read_blocks(spark, path, valueType="float", region=",".join(map(str, (*offset, *size))))
    moved = blocks.withColumns({f"o{a}": F.col(f"o{a}") - o for a, o in zip("xyz", offset, strict=True)})
    write_volume(moved, folder, VolumeBuilder(size))


def unstack(spark: SparkSession, path: str, folder: str, nx: int, ny: int) -> None:
    """Write each section as a volume of its own."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\..*$", "")
    rows = read_blocks(spark, path, valueType="float").withColumn("path", F.concat(stem, F.lit("-"), F.col("oz").cast("string")))
    write_volume(rows.withColumn("oz", F.lit(0)), folder, VolumeBuilder((nx, ny, 1)))


def rescale_down(spark: SparkSession, path: str, factor: int) -> DataFrame:
    return downsample(read_voxels(spark, path, valueType="float"), factor)
