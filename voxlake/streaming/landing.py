"""A landing folder as a stream: new volume files become block rows as they arrive.

Delivery is Structured Streaming's: files are tracked in the checkpoint, each is decoded once
for a sink that is idempotent or transactional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxlake.operators.stats import block_mean
from voxlake.sources.volumetric import decode_binary

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def landing_blocks(spark: SparkSession, folder: str, target: str = "float", permissive: bool = True, files_per_batch: int = 100) -> DataFrame:
    """Streaming block rows (a section each) of the volumes that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decode_binary(files, target=target, permissive=permissive)


def section_means(blocks: DataFrame) -> DataFrame:
    return blocks.select("path", F.col("oz").alias("z"), block_mean(F.col("data")).alias("mean"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it as Parquet, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
