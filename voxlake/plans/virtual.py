"""Virtual volumes: dense volumes laid over the driver's tables, so that every operator can be compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.regions import Shape


def _div(c: str, n: int):  # noqa: ANN202
    return F.floor(F.col(c) / n)


def embeddings_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, value): a row of 64 floats for each vec_id; 50 rows a section. Sections form a stack of five."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = t.select("vec_id", F.posexplode("embedding").alias("x", "value"))
    return long.select(_div("vec_id", 50).cast("int").alias("z"), (F.col("vec_id") % 50).cast("int").alias("y"), "x", "value")


def embeddings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same volume as block rows of one voxel row each (ox oy oz sx sy sz data)."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = F.lit(1)
    return t.select(F.lit("emb").alias("path"), F.lit(0).alias("ox"), (F.col("vec_id") % 50).cast("int").alias("oy"), _div("vec_id", 50).cast("int").alias("oz"), F.size("embedding").alias("sx"), one.alias("sy"), one.alias("sz"), F.col("embedding").alias("data"))


def events_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, z, y, x, value): 10 by 10 voxels a section, in the order of event_id."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    e = F.col("event_id")
    return t.select(e.alias("idx"), _div("event_id", 100).cast("int").alias("z"), (_div("event_id", 10) % 10).cast("int").alias("y"), (e % 10).cast("int").alias("x"), "value")


def events_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, z, re, im)."""
    v = events_volume(spark, sf_dir)
    return v.select("idx", "z", (F.col("value") - 100).alias("re"), ((F.col("idx") % 97) - 48).cast("double").alias("im"))


def events_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, z, y, x, i16, u16, u4): integer images."""
    v = events_volume(spark, sf_dir)
    i16 = F.least(F.greatest(F.floor(F.col("value") * 100) - 20000, F.lit(-32768)), F.lit(32767)).cast("smallint")
    return v.select("idx", "z", "y", "x", i16.alias("i16"), (F.col("idx") % 65536).cast("int").alias("u16"), (F.col("idx") % 16).cast("tinyint").alias("u4"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): UTF-8 bytes of whole texts."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", F.col("text").cast("binary").alias("raw"))


def events_shape(n: int) -> Shape:
    return Shape(10, 10, n // 100)
