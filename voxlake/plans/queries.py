"""Registered queries over virtual volumes and header rows, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import convert as C
from voxlake.functions import header as H
from voxlake.functions import modes as M
from voxlake.operators import regions as R
from voxlake.operators import stats as S
from voxlake.operators import validate as V
from voxlake.plans import virtual as P
from voxlake.plans.header_rows import HEADER_SQL, header_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EM = "WITH em AS (SELECT (vec_id // 50)::INT AS z, (vec_id % 50)::INT AS y, (i - 1)::INT AS x, v AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
EV = "WITH ev AS (SELECT event_id AS idx, (event_id // 100)::INT AS z, ((event_id // 10) % 10)::INT AS y, (event_id % 10)::INT AS x, value FROM events)"
EC = "WITH ec AS (SELECT event_id AS idx, (event_id // 100)::INT AS z, value - 100 AS re, (event_id % 97 - 48)::DOUBLE AS im FROM events)"
EI = "WITH ei AS (SELECT event_id AS idx, (event_id // 100)::INT AS z, (event_id % 10)::INT AS x, ((event_id // 10) % 10)::INT AS y, least(greatest(floor(value * 100) - 20000, -32768), 32767)::SMALLINT AS i16, (event_id % 65536)::INT AS u16, (event_id % 16)::TINYINT AS u4 FROM events)"
STATS = "count(*)::BIGINT AS n, min(value)::DOUBLE AS dmin, max(value)::DOUBLE AS dmax, round(avg(value::DOUBLE), 9) AS dmean, round(stddev_pop(value::DOUBLE), 9) AS rms"


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stats() -> list:
    n, low, high, mean, rms = S.density_stats(F.col("value"))
    return [n, low, high, F.round(F.avg(F.col("value").cast("double")), 9).alias("dmean"), F.round(F.stddev_pop(F.col("value").cast("double")), 9).alias("rms")]


def _events_count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


# regions


@query(f"{EM} SELECT z, {STATS} FROM em GROUP BY z")
def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slices(P.embeddings_volume(spark, sf_dir)).groupBy(F.col("slice").alias("z")).agg(*_stats())


@query(f"{EM} SELECT (z // 4)::INT AS slab, (z // 4 * 4)::INT AS z0, least(4, (SELECT max(z) + 1 FROM em) - z // 4 * 4)::INT AS sz, {STATS} FROM em GROUP BY ALL")
def slab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.embeddings_volume(spark, sf_dir)
    nz = (spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() + 49) // 50
    return R.slabs(v, 4, nz).groupBy("slab", "z0", "sz").agg(*_stats())


@query(
    f"""{EV} SELECT (x // 4)::INT AS tx, (y // 4)::INT AS ty, (z // 3)::INT AS tz, (x // 4 * 4)::INT AS ox, (y // 4 * 4)::INT AS oy, (z // 3 * 3)::INT AS oz,
    least(4, 10 - x // 4 * 4)::INT AS sx, least(4, 10 - y // 4 * 4)::INT AS sy, least(3, (SELECT count(*) // 100 FROM events) - z // 3 * 3)::INT AS sz, {STATS} FROM ev GROUP BY ALL"""
)
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = P.events_shape(_events_count(spark, sf_dir))
    keys = [f"{k}{a}" for k in "tos" for a in "xyz"]
    return R.tiles(P.events_volume(spark, sf_dir), (4, 4, 3), shape).groupBy(*keys).agg(*_stats())


@query(f"{EM} SELECT (z // 5)::INT AS vol, {STATS} FROM em GROUP BY ALL")
def subvolume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sub_volumes(P.embeddings_volume(spark, sf_dir), 5, 401).groupBy("vol").agg(*_stats())


@query(f"{EV} SELECT z, y, x, value FROM ev WHERE x >= 2 AND x < 7 AND y >= 3 AND y < 7 AND z >= 4 AND z < 7")
def subregion_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = P.events_shape(_events_count(spark, sf_dir))
    return R.subregion(P.events_volume(spark, sf_dir), (2, 3, 4), (5, 4, 3), shape).select("z", "y", "x", "value")


@query(
    """WITH em AS (SELECT (vec_id // 50)::INT AS z, (vec_id % 50)::INT AS y, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS x FROM embeddings)
    SELECT z, count(*)::BIGINT AS n, round(sum(v::DOUBLE), 6) AS total FROM em WHERE x >= 5 AND x < 25 AND y >= 10 AND y < 30 AND z >= 2 AND z < 8 GROUP BY z"""
)
def block_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box cut from block rows by slicing their arrays."""
    cut = R.crop_blocks(P.embeddings_rows(spark, sf_dir), (5, 10, 2), (20, 20, 6))
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return cut.groupBy(F.col("oz").alias("z")).agg(F.sum(F.size("data")).cast("long").alias("n"), F.round(F.sum(total), 6).alias("total"))


@query(f"{EM} SELECT z, round(avg(value::DOUBLE), 9) AS mean FROM em GROUP BY z")
def block_slice_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice means from block rows, without exploding them."""
    rows = P.embeddings_rows(spark, sf_dir)
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.groupBy(F.col("oz").alias("z")).agg(F.round(F.sum(total) / F.sum(F.size("data")), 9).alias("mean"))


_BOXES = [(i, (i % 7) - 1, i % 5, i % 11, 1 + i % 9, 1 + i % 6, 1 + i % 4) for i in range(60)]


@query(
    f"""WITH b AS (SELECT * FROM (VALUES {", ".join(map(str, _BOXES))}) t(box, ox, oy, oz, sx, sy, sz)), n AS (SELECT count(*) // 100 AS nz FROM events)
    SELECT box::INT AS box, ox >= 0 AND oy >= 0 AND oz >= 0 AND ox + sx <= 10 AND oy + sy <= 10 AND oz + sz <= nz AS fits,
    (ox + oy * 10 + oz * 100)::BIGINT AS first_index, (sx * sy * sz)::BIGINT AS n_voxels FROM b, n"""
)
def subregion_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = P.events_shape(_events_count(spark, sf_dir))
    b = spark.createDataFrame(_BOXES, "box int, ox int, oy int, oz int, sx int, sy int, sz int")
    fits = F.lit(True)
    for a, n in zip("xyz", (shape.nx, shape.ny, shape.nz), strict=True):
        fits = fits & (F.col(f"o{a}") >= 0) & (F.col(f"o{a}") + F.col(f"s{a}") <= n)
    first = R.linear_index(F.col("ox"), F.col("oy"), F.col("oz"), 10, 10)
    return b.select("box", fits.alias("fits"), first.alias("first_index"), (F.col("sx") * F.col("sy") * F.col("sz")).cast("long").alias("n_voxels"))


@query(f"{EM} SELECT count(*)::BIGINT AS n, round(sum(value::DOUBLE), 6) AS total FROM em")
def volume_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.embeddings_volume(spark, sf_dir).agg(F.count("value").alias("n"), F.round(F.sum(F.col("value").cast("double")), 6).alias("total"))


@query(f"{EV} SELECT idx, (x + y * 10 + z * 100)::BIGINT AS recomputed FROM ev")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", R.linear_index(F.col("x"), F.col("y"), F.col("z"), 10, 10).alias("recomputed"))


@query(f"{EV} SELECT count(DISTINCT z)::BIGINT AS n_slices, count(DISTINCT z // 3)::BIGINT AS n_slabs, count(DISTINCT (x // 4, y // 4, z // 3))::BIGINT AS n_tiles, count(DISTINCT z // 5)::BIGINT AS n_volumes FROM ev")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.region_counts(P.events_shape(_events_count(spark, sf_dir)), 3, (4, 4, 3), 5)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"{EV} SELECT (z // 2)::INT AS z, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(value), 9) AS value FROM ev GROUP BY ALL")
def block_mean_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.downsample(P.events_volume(spark, sf_dir), 2).withColumn("value", F.round("value", 9))


# conversions

def _scaled() -> F.Column:
    """Both ends clamp."""
    return F.col("value") * 97 - 20000


_SCALED_SQL = "value * 97 - 20000"


@query(f"{EI} SELECT idx, i16::FLOAT AS from_i16, u16::FLOAT AS from_u16, u4::FLOAT AS from_u4 FROM ei")
def to_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_integers(spark, sf_dir).select("idx", *(C.to_float(F.col(c)).alias(f"from_{c}") for c in ("i16", "u16", "u4")))


@query(f"{EV} SELECT idx, trunc(least(greatest({_SCALED_SQL}, -32768), 32767))::SMALLINT AS v FROM ev")
def f32_to_i16_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_i16(_scaled()).alias("v"))


@query(f"{EV} SELECT idx, least(greatest(round_even({_SCALED_SQL}, 0), -32768), 32767)::SMALLINT AS v FROM ev")
def f32_to_i16_rne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_i16(_scaled(), "half_even").alias("v"))


@query(f"{EV} SELECT idx, trunc(least(greatest({_SCALED_SQL}, 0), 65535))::INT AS v FROM ev")
def f32_to_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_u16(_scaled()).alias("v"))


@query(f"{EV} SELECT idx, trunc(least(greatest(value - 150, -128), 127))::TINYINT AS v FROM ev")
def f32_to_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_i8(F.col("value") - 150).alias("v"))


@query(
    f"""{EV} SELECT idx, CASE WHEN idx % 101 = 7 THEN 0 WHEN idx % 101 = 8 THEN 32767 WHEN idx % 101 = 9 THEN -32768 ELSE trunc(least(greatest(value, -32768), 32767)) END::SMALLINT AS v FROM ev"""
)
def f32_to_i16_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_i16(_injected("value")).alias("v"))


@query(
    f"""{EI} SELECT idx, least(greatest(i16, -128), 127)::TINYINT AS i16_i8, greatest(i16, 0)::INT AS i16_u16, least(u16, 127)::TINYINT AS u16_i8,
    least(u16, 32767)::SMALLINT AS u16_i16, u4::SMALLINT AS i8_i16, greatest(u4 - 8, 0)::INT AS i8_u16 FROM ei"""
)
def int_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i16, u16, i8 = F.col("i16"), F.col("u16"), F.col("u4")
    pairs = {"i16_i8": (i16, "byte"), "i16_u16": (i16, "ushort"), "u16_i8": (u16, "byte"), "u16_i16": (u16, "short"), "i8_i16": (i8, "short"), "i8_u16": (i8.cast("int") - 8, "ushort")}
    return P.events_integers(spark, sf_dir).select("idx", *(C.clamp_int(c, t).alias(n) for n, (c, t) in pairs.items()))


def _complex(strategy: str, expression: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = C.complex_to_real(F.col("re"), F.col("im"), strategy).cast("double")
        return P.events_complex(spark, sf_dir).select("idx", F.round(v, 4).alias("v"))

    f.__name__ = f"complex_{strategy}"
    query(f"{EC} SELECT idx, round(({expression})::FLOAT::DOUBLE, 4) AS v FROM (SELECT idx, re::FLOAT::DOUBLE AS re, im::FLOAT::DOUBLE AS im FROM ec)")(f)


for _s, _e in (("real", "re"), ("imaginary", "im"), ("magnitude", "sqrt(re * re + im * im)"), ("phase", "atan2(im, re)")):
    _complex(_s, _e)


@query(f"{EI} SELECT idx, u4 AS v FROM ei")
def unpack_u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ten voxels packed to five bytes, and unpacked again."""
    v = P.events_integers(spark, sf_dir)
    at = F.floor(F.col("x") / 2).cast("int")
    bytes_ = v.groupBy("z", "y", at.alias("b")).agg(F.max(F.when(F.col("x") % 2 == 0, F.col("u4"))).alias("low"), F.max(F.when(F.col("x") % 2 == 1, F.col("u4"))).alias("high"))
    packed = bytes_.withColumn("byte", C.pack_nibbles(F.col("low"), F.col("high")))
    x = F.explode(F.array(F.col("b") * 2, F.col("b") * 2 + 1))
    rows = packed.select("z", "y", "byte", x.alias("x"))
    return rows.select(R.linear_index(F.col("x"), F.col("y"), F.col("z"), 10, 10).alias("idx"), C.unpack_nibble(F.col("byte"), F.col("x")).alias("v"))


@query(
    f"""{EI} SELECT z, y, (x // 2)::INT AS b, (max(CASE WHEN x % 2 = 0 THEN u4 ELSE 0 END) + 16 * max(CASE WHEN x % 2 = 1 THEN u4 ELSE 0 END)::INT)::INT AS byte FROM ei WHERE x < 9 GROUP BY ALL"""
)
def pack_u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nine voxels: the last byte's upper nibble is 0."""
    v = P.events_integers(spark, sf_dir).where("x < 9")
    at = F.floor(F.col("x") / 2).cast("int")
    low, high = (F.max(F.when(F.col("x") % 2 == k, F.col("u4"))) for k in (0, 1))
    return v.groupBy("z", "y", at.alias("b")).agg(C.pack_nibbles(low, high).alias("byte"))


def _byte_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.text_bytes(spark, sf_dir)
    return raw.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.octet_length("raw") - 1)).alias("k", "i"), "raw").where(F.octet_length("raw") > 0)


def _byte_sql(value: str) -> str:
    return f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM h),
    d AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i::INT + 1, 2))::INT AS b FROM b)
    SELECT doc_id, count(*)::BIGINT AS n, sum({value})::BIGINT AS total, sum(({value}) * (i % 1000))::BIGINT AS weighted FROM d GROUP BY doc_id"""


def _byte_sums(rows: DataFrame, value: F.Column) -> DataFrame:
    v = value.cast("long")
    return rows.select("doc_id", "i", v.alias("v")).groupBy("doc_id").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("i") % 1000)).alias("weighted"))


@query(_byte_sql("CASE WHEN b >= 128 THEN b - 256 ELSE b END"))
def mode0_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _byte_table(spark, sf_dir)
    return _byte_sums(rows, C.reinterpret_mode0(C.stored_int(F.col("raw"), F.col("i"), 1, "little", False), False))


@query(_byte_sql("b"))
def mode0_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _byte_table(spark, sf_dir)
    return _byte_sums(rows, C.reinterpret_mode0(C.stored_int(F.col("raw"), F.col("i"), 1, "little", True), True))


@query(_byte_sql("(b & 15) + 100 * (b >> 4)"))
def nibbles_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = C.nibbles(C.stored_int(F.col("raw"), F.col("i"), 1, "little", False))
    return _byte_sums(_byte_table(spark, sf_dir), low + 100 * high)


def _word_query(name: str, endian: str, signed: bool) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = P.text_bytes(spark, sf_dir).where(F.octet_length("raw") >= 2)
        rows = raw.select("doc_id", F.posexplode(C.stored_ints(F.col("raw"), 2, endian, signed)).alias("i", "v"))
        return _byte_sums(rows, F.col("v"))

    f.__name__ = name
    pair = "substr(h, 4 * i::INT + 1, 4)" if endian == "big" else "substr(h, 4 * i::INT + 3, 2) || substr(h, 4 * i::INT + 1, 2)"
    value = "CASE WHEN w >= 32768 THEN w - 65536 ELSE w END" if signed else "w"
    query(
        f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 2), b AS (SELECT doc_id, unnest(range(0, len(h) // 4)) AS i, h FROM h),
        d AS (SELECT doc_id, i, ('0x' || {pair})::INT AS w FROM b), v AS (SELECT doc_id, i, {value} AS v FROM d)
        SELECT doc_id, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, sum(v * (i % 1000))::BIGINT AS weighted FROM v GROUP BY doc_id"""
    )(f)


for _n, _e, _s in (("decode_i16_le", "little", True), ("decode_i16_be", "big", True), ("decode_u16_be", "big", False)):
    _word_query(_n, _e, _s)


def _swapped(name: str, width: int) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        size = F.floor(F.octet_length("raw") / width).cast("int") * width
        raw = P.text_bytes(spark, sf_dir).where(F.octet_length("raw") >= width).select("doc_id", C.swap_bytes(F.substring("raw", F.lit(1), size), F.lit(width)).alias("raw"))
        return _byte_sums(raw.select("doc_id", F.posexplode(C.stored_ints(F.col("raw"), 1, "little", False)).alias("i", "v")), F.col("v"))

    f.__name__ = name
    query(
        f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= {width}), b AS (SELECT doc_id, unnest(range(0, len(h) // {2 * width} * {width})) AS i, h FROM h),
        d AS (SELECT doc_id, i, ('0x' || substr(h, 2 * (i // {width} * {width} + {width - 1} - i % {width})::INT + 1, 2))::INT AS v FROM b)
        SELECT doc_id, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, sum(v * (i % 1000))::BIGINT AS weighted FROM d GROUP BY doc_id"""
    )(f)


for _n, _w in (("swap_bytes_2", 2), ("swap_bytes_4", 4), ("swap_bytes_8", 8)):
    _swapped(_n, _w)


@query(f"{EI} SELECT idx, u16::SMALLINT AS v FROM ei WHERE u16 < 256")
def u16_to_u8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_integers(spark, sf_dir).where("u16 < 256").select("idx", C.u16_to_u8(F.col("u16")).alias("v"))


@query(f"{EI} SELECT idx, CASE WHEN u16 <= 255 THEN u16 ELSE -1 END::SMALLINT AS v FROM ei")
def u16_to_u8_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_integers(spark, sf_dir).select("idx", F.coalesce(C.u16_to_u8(F.col("u16"), checked=False), F.lit(-1).cast("smallint")).alias("v"))


@query(f"{EI} SELECT idx, u4::INT AS v FROM ei")
def u8_to_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_integers(spark, sf_dir).select("idx", C.u8_to_u16(F.col("u4")).alias("v"))


# eleven significant bits, ties to even; values of normal size, which the events have
@query(
    f"""{EV}, f AS (SELECT idx, value::FLOAT::DOUBLE AS x FROM ev), e AS (SELECT idx, x, pow(2.0, floor(log2(abs(x))) - 10) AS unit FROM f WHERE x <> 0),
    q AS (SELECT idx, x / unit AS k, floor(x / unit) AS low, unit FROM e)
    SELECT idx, ((CASE WHEN k - low > 0.5 OR (k - low = 0.5 AND low % 2 <> 0) THEN low + 1 ELSE low END) * unit)::FLOAT AS v FROM q UNION ALL SELECT idx, 0::FLOAT FROM f WHERE x = 0"""
)
def f32_to_f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_volume(spark, sf_dir).select("idx", C.float_to_f16(F.col("value").cast("float")).alias("v"))


# aggregation


@query(f"{EC} SELECT z, count(*)::BIGINT AS n, 0.0::DOUBLE AS dmin, -1.0::DOUBLE AS dmax, -2.0::DOUBLE AS dmean, round(sqrt(var_pop(re) + var_pop(im)), 6) AS rms FROM ec GROUP BY z")
def density_stats_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.events_complex(spark, sf_dir).groupBy("z").agg(*S.complex_stats(F.col("re"), F.col("im")))
    return out.withColumn("rms", F.round("rms", 6))


@query(f"{EI} SELECT z, count(*)::BIGINT AS n, min(u4)::DOUBLE AS dmin, max(u4)::DOUBLE AS dmax, round(avg(u4), 9) AS dmean, round(stddev_pop(u4), 9) AS rms FROM ei GROUP BY z")
def density_stats_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.events_integers(spark, sf_dir).withColumn("value", F.col("u4")).groupBy("z").agg(*_stats())


@query("SELECT 0::BIGINT AS n, 0.0::DOUBLE AS dmin, -1.0::DOUBLE AS dmax, -2.0::DOUBLE AS dmean, -1.0::DOUBLE AS rms")
def density_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_sentinels(P.events_volume(spark, sf_dir).where("z < 0").agg(*S.density_stats(F.col("value"))))


def _injected(c: str):  # noqa: ANN202
    """NaN, +Inf and -Inf at three of every 101 voxels."""
    at = F.col("idx") % 101
    return F.when(at == 7, float("nan")).when(at == 8, float("inf")).when(at == 9, float("-inf")).otherwise(F.col(c))


@query(
    f"""{EV}, c AS (SELECT z, count_if(idx % 101 = 7) AS a, count_if(idx % 101 = 8) AS b, count_if(idx % 101 = 9) AS c, count(*) AS n FROM ev GROUP BY z)
    SELECT z, a::BIGINT AS n_nan, b::BIGINT AS n_pinf, c::BIGINT AS n_ninf, round(100.0::DOUBLE * (a + b + c) / n, 9) AS pct FROM c"""
)
def nonfinite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.events_volume(spark, sf_dir).groupBy("z").agg(*S.nonfinite_counts(_injected("value")))
    return out.withColumn("pct", F.round("pct", 9))


@query(
    f"""{EV}, c AS (SELECT z, count_if(idx % 101 = 7) AS a, count_if(idx % 101 = 8) AS b, count_if(idx % 101 = 9) AS c, count(*) AS n FROM ev GROUP BY z)
    SELECT z, a::BIGINT AS n_nan, b::BIGINT AS n_pinf, c::BIGINT AS n_ninf, round(100.0::DOUBLE * (a + b + c) / (2 * n), 9) AS pct FROM c"""
)
def nonfinite_counts_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.events_volume(spark, sf_dir).groupBy("z").agg(*S.nonfinite_counts(_injected("value"), F.col("value")))
    return out.withColumn("pct", F.round("pct", 9))


@query(
    f"""{EV} SELECT z, count(*)::BIGINT AS n, min(CASE WHEN idx % 101 <> 7 THEN value END) AS dmin, max(CASE WHEN idx % 101 <> 7 THEN value END) AS dmax,
    count_if(idx % 101 = 7) > 0 AS mean_is_nan FROM ev GROUP BY z"""
)
def density_stats_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is left out of the extremes and spreads into the mean."""
    v = F.when(F.col("idx") % 101 == 7, float("nan")).otherwise(F.col("value"))
    out = P.events_volume(spark, sf_dir).withColumn("value", v).groupBy("z").agg(*S.density_stats(F.col("value")))
    return out.select("z", "n", "dmin", "dmax", F.isnan("dmean").alias("mean_is_nan"))


@query(
    f"""{EM}, s AS (SELECT z, min(value)::DOUBLE AS dmin, max(value)::DOUBLE AS dmax, avg(value::DOUBLE) AS dmean, stddev_pop(value::DOUBLE) AS rms FROM em GROUP BY z),
    f AS (SELECT *, CASE z % 4 WHEN 0 THEN 1.005::DOUBLE WHEN 1 THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END AS k FROM s)
    SELECT z, z % 4 = 3 OR abs(dmin * k - dmin) <= 0.01::DOUBLE * greatest(abs(dmin * k), abs(dmin)) AS min_ok, z % 4 = 3 OR abs(dmax * k - dmax) <= 0.01::DOUBLE * greatest(abs(dmax * k), abs(dmax)) AS max_ok,
    z % 4 = 3 OR abs(dmean * k - dmean) <= 0.01::DOUBLE * greatest(abs(dmean * k), abs(dmean)) AS mean_ok, z % 4 = 3 OR abs(rms * k - rms) <= 0.01::DOUBLE * greatest(abs(rms * k), abs(rms)) AS rms_ok FROM f"""
)
def stats_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims off by 0.5 %, by 2 %, exact and unset, against the data."""
    actual = P.embeddings_volume(spark, sf_dir).groupBy("z").agg(*S.density_stats(F.col("value")))
    k = F.when(F.col("z") % 4 == 0, 1.005).when(F.col("z") % 4 == 1, 1.02).otherwise(1.0)
    unset = F.col("z") % 4 == 3
    claims = [F.when(unset, v).otherwise(F.col(c) * k).alias(c) for c, v in zip(("dmin", "dmax", "dmean", "rms"), S.SENTINELS, strict=True)]
    return S.claims_hold(actual.select("z", *claims), actual, ["z"])


@query(f"{EM}, s AS (SELECT z, round(avg(value::DOUBLE), 9) AS mean FROM em GROUP BY z) SELECT z, CASE WHEN z % 2 = 0 THEN -60.0 + 3.0 * z END::DOUBLE AS tilt, mean FROM s")
def slice_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with their tilt records; every second section has one."""
    from voxlake.operators.exthdr import with_section_metadata

    means = P.embeddings_volume(spark, sf_dir).groupBy("z").agg(F.round(F.avg(F.col("value").cast("double")), 9).alias("mean"))
    nz = (spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() + 49) // 50
    records = spark.range(0, nz, 2).select(F.col("id").cast("int").alias("z"), (F.col("id") * 3.0 - 60.0).alias("tilt"))
    return with_section_metadata(means, records, ["z"])


# headers


@query(
    f"""{HEADER_SQL} SELECT id, round(CASE WHEN mx = 0 THEN 0 ELSE xlen / mx END, 9) AS vx, round(CASE WHEN my = 0 THEN 0 ELSE ylen / my END, 9) AS vy, round(CASE WHEN mz = 0 THEN 0 ELSE zlen / mz END, 9) AS vz,
    round(CASE WHEN xlen <= 0 OR ylen <= 0 OR zlen <= 0 THEN 0 ELSE xlen * ylen * zlen * sqrt(greatest(1 - cos(radians(alpha)) ^ 2 - cos(radians(beta)) ^ 2 - cos(radians(gamma)) ^ 2 + 2 * cos(radians(alpha)) * cos(radians(beta)) * cos(radians(gamma)), 0)) END, 6) AS cell,
    CASE WHEN nz = 1 THEN 'single image' WHEN ispg = 0 THEN 'image stack' WHEN ispg BETWEEN 400 AND 630 THEN 'volume stack' ELSE 'volume' END AS kind,
    CASE WHEN ispg BETWEEN 400 AND 630 THEN CASE WHEN mz > 0 THEN [floor(nz / mz), mz, ny, nx] ELSE [0, 0, ny, nx] END ELSE [1, nz, ny, nx] END::INT[]::VARCHAR AS logical_shape,
    (1024 + greatest(nsymbt, 0))::BIGINT AS data_offset, mapr = -2 AS y_inverted FROM hdr"""
)
def header_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    shape = H.logical_shape(c("nx"), c("ny"), c("nz"), c("mz"), c("ispg"))
    sizes = [F.round(H.voxel_size(c(f"{a}len"), c(f"m{a}")), 9).alias(f"v{a}") for a in "xyz"]
    cell = H.cell_volume(*(c(n) for n in ("xlen", "ylen", "zlen", "alpha", "beta", "gamma")))
    text = F.concat(F.lit("["), F.concat_ws(", ", F.transform(shape, lambda x: x.cast("string"))), F.lit("]"))
    return header_rows(spark, sf_dir).select("id", *sizes, F.round(cell, 6).alias("cell"), H.volume_kind(c("nz"), c("ispg")).alias("kind"), text.alias("logical_shape"), H.data_offset(c("nsymbt")).alias("data_offset"), H.is_y_inverted(c("mapr")).alias("y_inverted"))


_STRICT_SQL = """CASE WHEN nx <= 0 OR ny <= 0 OR nz <= 0 THEN 'InvalidDimensions' WHEN mode NOT IN (0, 1, 2, 3, 4, 6, 12, 101) THEN 'UnsupportedMode' WHEN map <> 'MAP ' THEN 'InvalidMap'
    WHEN NOT (ispg BETWEEN 0 AND 230 OR ispg BETWEEN 400 AND 630) THEN 'InvalidIspg' WHEN list_sort([mapc, mapr, maps]) <> [1, 2, 3] THEN 'InvalidAxisMapping' WHEN nsymbt < 0 THEN 'InvalidNsymbt'
    WHEN nlabl NOT BETWEEN 0 AND 10 THEN 'InvalidNlabl' WHEN (label_a <> '')::INT + (label_b <> '')::INT <> nlabl THEN 'LabelCountMismatch' WHEN nlabl = 1 AND label_a = '' THEN 'EmptyLabelBeforeFilled'
    WHEN nversion NOT IN (0, 20140, 20141) THEN 'InvalidNversion' WHEN mx <= 0 OR my <= 0 OR mz <= 0 THEN 'InvalidSampling' WHEN ispg BETWEEN 400 AND 630 AND nz % mz <> 0 THEN 'InvalidVolumeStack' END"""


@query(f"{HEADER_SQL} SELECT id, {_STRICT_SQL} AS error_code FROM hdr")
def header_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_rows(spark, sf_dir).select("id", V.first_error().alias("error_code"))


@query(
    f"""{HEADER_SQL} SELECT id, CASE WHEN nx <= 0 OR ny <= 0 OR nz <= 0 THEN 'InvalidDimensions' WHEN mode NOT IN (0, 1, 2, 3, 4, 6, 12, 101) THEN 'UnsupportedMode' END AS fatal,
    ((map <> 'MAP ')::INT + (NOT (ispg BETWEEN 0 AND 230 OR ispg BETWEEN 400 AND 630))::INT + (list_sort([abs(mapc), abs(mapr), abs(maps)]) <> [1, 2, 3] OR mapr = -2)::INT + (nsymbt < 0)::INT + (nlabl NOT BETWEEN 0 AND 10)::INT
    + (nversion NOT IN (20140, 20141))::INT + (mx <= 0 OR my <= 0 OR mz <= 0)::INT + (ispg BETWEEN 400 AND 630 AND mz <> 0 AND nz % (CASE WHEN mz = 0 THEN 1 ELSE mz END) <> 0)::INT)::INT AS n_warnings FROM hdr"""
)
def header_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_rows(spark, sf_dir).select("id", V.fatal_error().alias("fatal"), F.size(V.permissive_warnings()).alias("n_warnings"))


_STAMP = "CASE event_id % 3 WHEN 0 THEN '4444' WHEN 1 THEN '1111' ELSE lpad(hex(event_id % 65536), 4, '0') END || '0000'"


@query(f"WITH t AS (SELECT event_id AS id, {_STAMP} AS stamp FROM events) SELECT id, CASE WHEN stamp LIKE '1111%' THEN 'big' ELSE 'little' END AS endian, stamp LIKE '1111%' OR stamp LIKE '4444%' AS is_standard FROM t")
def machst_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.expr(_STAMP).alias("stamp"))
    endian, standard = H.machst_endian(F.col("stamp"))
    return t.select("id", endian.alias("endian"), standard.alias("is_standard"))


_PREFIX = "CASE page_id % 4 WHEN 0 THEN '1F8B' WHEN 1 THEN '425A' WHEN 2 THEN '1F' ELSE '' END"


@query(f"WITH t AS (SELECT page_id, {_PREFIX} || hex(encode(html)) AS h FROM pages) SELECT page_id, CASE WHEN h LIKE '1F8B%' THEN 'gzip' WHEN h LIKE '425A%' THEN 'bzip2' ELSE 'plain' END AS compression FROM t")
def compression_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.unhex(F.expr(_PREFIX)), F.col("html").cast("binary"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.detect_compression(raw).alias("compression"))


@query("SELECT doc_id, regexp_replace(rpad(s, 80, ' '), '\\s+$', '') AS label, trim(s) = '' AS is_blank FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat(' ', (doc_id % 80)::INT) ELSE substr(text, 1, 1 + (doc_id % 80)::INT) END AS s FROM documents)")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut from texts, and blank ones."""
    size = (F.col("doc_id") % 80).cast("int")
    raw = F.rpad(F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit(" "), size)).otherwise(F.substring("text", F.lit(1), size + 1)), 80, " ")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", H.label_text(raw).alias("label"), H.label_blank(raw).alias("is_blank"))


_CODES = "CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 6 WHEN 6 THEN 12 ELSE 101 END"


@query(
    f"""WITH t AS (SELECT event_id AS id, {_CODES} AS code, event_id % 9 AS nx, event_id % 5 AS ny, event_id % 4 AS nz FROM events),
    m(code, name, size, cplx, ints, floats) AS (VALUES (0, 'Int8', 1, false, true, false), (1, 'Int16', 2, false, true, false), (2, 'Float32', 4, false, false, true),
    (3, 'Int16Complex', 4, true, true, false), (4, 'Float32Complex', 8, true, false, true), (6, 'Uint16', 2, false, true, false), (12, 'Float16', 2, false, false, true), (101, 'Packed4Bit', 1, false, true, false))
    SELECT id, name, size::INT AS size, cplx AS is_complex, ints AS is_integer, floats AS is_float, (CASE WHEN code = 101 THEN (nx + 1) // 2 ELSE size * nx END)::BIGINT AS row_bytes,
    (CASE WHEN code = 101 THEN (nx + 1) // 2 ELSE size * nx END * ny * nz)::BIGINT AS data_size FROM t JOIN m USING (code)"""
)
def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each mode, and the bytes of rows and volumes of several sizes."""
    e = F.col("event_id")
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("id"), F.expr(_CODES).alias("code"), (e % 9).alias("nx"), (e % 5).alias("ny"), (e % 4).alias("nz"))
    c = F.col("code")
    size = M.data_size(F.col("nx"), F.col("ny"), F.col("nz"), c)
    return t.select("id", M.mode_name(c).alias("name"), M.mode_byte_size(c).alias("size"), M.mode_is_complex(c).alias("is_complex"), M.mode_is_integer(c).alias("is_integer"), M.mode_is_float(c).alias("is_float"), M.mode_bytes_for_count(c, F.col("nx")).alias("row_bytes"), size.alias("data_size"))


@query(
    f"""{HEADER_SQL}, e AS (SELECT id, {_STRICT_SQL} AS code FROM hdr)
    SELECT 'header-' || id AS path, code IS NULL AS is_valid, (code IS NOT NULL)::BIGINT AS n_error, 0::BIGINT AS n_warning FROM e"""
)
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = header_rows(spark, sf_dir).select(F.concat(F.lit("header-"), F.col("id")).alias("path"), F.lit("little").alias("endian"), F.lit(True).alias("standard_stamp"), F.array().cast("array<string>").alias("warnings"), "*")
    return V.roll_up(V.header_issues(rows))
