"""Session helpers shared by every operator: code shipping, shared storage, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths in the shared folder that this driver has made.
_FRESH: list[str] = []


def builder(app: str = "voxlake", cores: int | None = None) -> SparkSession.Builder:
    """A session builder with the settings the operators expect (AQE, UTC, filter pushdown into Python sources)."""
    b = SparkSession.builder.appName(app)
    if cores:
        b = b.master(f"local[{cores}]")
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
    )


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's default of 64: several tasks and their Python workers share an executor."""
    if spark.conf.get(_BATCH) in ("64MB", "64m", "67108864b", str(64 << 20)):
        spark.conf.set(_BATCH, "8m")


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="voxlake-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "voxlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session names none, a folder of its own is set; that is for local mode
    only, since a cluster's machines do not share one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        base = named
    else:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            base = current
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="voxlake-shared-")
            atexit.register(shutil.rmtree, base[len("file://") :], True)
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/voxlake-{name}-{uuid.uuid4().hex}"
    if not _FRESH:
        atexit.register(_remove_fresh)
    _FRESH.append(path)
    return path


def _remove_fresh() -> None:
    for path in _FRESH:
        try:
            fs, local = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
            fs.delete_dir(local)
        except OSError:  # never written, or gone with its folder
            continue
    _FRESH.clear()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of finished steps.

    Its cleaner works when the driver's JVM collects garbage, which may be half an hour after a
    loop of many small jobs; until then their files stay on the executors' disks. It keeps what
    Python still refers to, and py4j tells it what Python has freed from a thread that may sleep a second.
    """
    gc.collect()
    untold, end = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.monotonic() + 2
    while untold and time.monotonic() < end:
        time.sleep(0.02)
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; for narrow tables that are used more than once."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back; for wide tables that are used more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
