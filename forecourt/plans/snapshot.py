"""A derived table that follows its source files: versions, freshness by file, atomic refresh.

A table folder holds ``data/run=...``, what one refresh derived, and ``versions/N``, the
manifest of version N: for each source file its size, its time, the run that read it and the
version of that run.  A version counts once Spark has committed its manifest, which is a refresh's
last step, so what a failed refresh has written is in no version.  Nothing written is ever changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "source_file"
MANIFEST = "file string, size long, modified timestamp, run string, version int"


def source_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size, modified) of all files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"))


def current_version(spark: SparkSession, table: str) -> int:
    """The highest committed version, 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit() and files.exists(done(f"{table}/versions/{n}/_SUCCESS"))), default=0)


def manifest(spark: SparkSession, table: str, version: int) -> DataFrame:
    if version == 0:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{table}/versions/{version}")


def refresh(
    spark: SparkSession, source: str, table: str, derive: Callable[[DataFrame], DataFrame],
    form: str = "parquet", pattern: str = "*", **options,
) -> int:
    """Bring the table up to date with its source files; gives its version.

    Files whose size or time differ from the manifest are read again, rows of files that are gone
    or changed leave the table, all others stay as they are.  ``derive`` works on rows, which have
    ``source_file`` besides their own columns, and keeps that column.  With nothing changed there is no new
    version.  The driver holds the names of changed files, as it does for any scan.  Of two refreshes
    at once one fails, since a version is written once.
    """
    before = current_version(spark, table)
    old, now = manifest(spark, table, before), source_files(spark, source, pattern)
    same = ["file", "size", "modified"]
    kept = old.join(now, same, "left_semi")
    changed = now.join(old, same, "left_anti")
    names = [r["file"] for r in changed.select("file").collect()]
    if before and not names and kept.count() == old.count():
        return before
    run = uuid.uuid4().hex
    if names:
        rows = spark.read.format(form).options(**options).load(names)
        derive(rows.select("*", F.col("_metadata.file_path").alias(SOURCE))).write.parquet(f"{table}/data/run={run}")
    fresh = changed.select(*same, F.lit(run).alias("run"), F.lit(before + 1).alias("version"))
    kept.select(fresh.columns).unionByName(fresh).write.mode("error").parquet(f"{table}/versions/{before + 1}")
    return before + 1


def read_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the current one if none is named, with the ``version`` that read each.

    A run's rows of files that later changed or went are not among them.
    """
    version = current_version(spark, table) if version is None else version
    if version == 0:
        raise ValueError(f"{table}: no version yet")
    files = manifest(spark, table, version)
    runs = [r["run"] for r in files.select("run").distinct().collect()]  # one per refresh that still counts
    paths = [f"{table}/data/run={r}" for r in runs] or [f"{table}/data"]  # without files: no rows, but their columns
    rows = spark.read.option("basePath", f"{table}/data").parquet(*paths)
    kept = files.select(F.col("file").alias(SOURCE), "run", "version")
    return rows.withColumn("run", F.col("run").cast("string")).join(kept, [SOURCE, "run"]).drop("run")
