"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("forecourt")
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _local_base(application_id: str) -> str:
    path = tempfile.mkdtemp(prefix=f"forecourt-{application_id}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@lru_cache(maxsize=8)
def _send_code(application_id: str, add_file: Callable) -> None:
    package = Path(__file__).resolve().parent
    archive = Path(_local_base(f"code-{application_id}")) / "forecourt-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    add_file(str(archive))


def send_code(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, wherever the driver found it.

    The driver's file server hands the archive out, so no folder has to be shared.
    """
    _send_code(spark.sparkContext.applicationId, spark.sparkContext.addPyFile)


def tidy(run: Callable) -> Callable:
    """A partition function that hands freed memory back to the system at its end.

    Python workers serve many tasks; what one task has freed would else stay with its
    worker beside the next task's memory.
    """
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
    return tidied


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for staged tables and stream checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a temporary folder of its own, removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = _local_base(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per array element; rows without elements drop out.

    For a plain explode the optimizer adds a filter on the array's size, which
    evaluates an expensive array expression a second time.  The outer form with
    a test on its output evaluates it once.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def posexplode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """As ``explode_once``, with the element's place in ``pos``."""
    rows = df.select(*keep, F.posexplode_outer(array).alias("pos", name))
    return rows.where(F.col("pos").isNotNull())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the working folder and read it back.

    Used where several results need one expensive intermediate: the files
    survive a lost executor, and the lineage ends there.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A scan dealt over as many tasks as the session states, else as it is.

    ``spark.forecourt.scanPartitions`` is for files that Spark cannot split, such as a
    small test file with one row group.  Without it nothing is shuffled.
    """
    stated = df.sparkSession.conf.get("spark.forecourt.scanPartitions", None)
    return df.repartition(int(stated)) if stated else df
