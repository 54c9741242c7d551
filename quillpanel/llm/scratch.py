"""Cutting lineage through tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster and is read from the
session; only where it is unset (tests on one machine) a private folder is made
and set.  Tables written here are ordinary Parquet: a lost executor costs a
re-read, never a recomputation of what came before, and nothing is kept in an
executor's own folder.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Seconds between two requests for garbage collection.
EVERY = 1.0
_own: dict[str, str] = {}
_released = 0.0


def folder(spark: SparkSession) -> str:
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {KEY} to a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quillpanel-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def _release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer referenced.

    Its cleaner acts when the driver's JVM collects garbage, which a driver with
    little to do puts off for half an hour while executors' disks fill.  Asked
    for at most once in EVERY seconds, as a large heap takes its time.
    """
    global _released
    if time.monotonic() - _released > EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a DataFrame that reads the written rows."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(folder(spark).replace("file://", "file:").rstrip("/")) or path.startswith(folder(spark)):
                jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
