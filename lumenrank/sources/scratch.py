"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the interpreter ends; a local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not root and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    path = f"{(root or '/tmp/checkpoints').rstrip('/')}/lumenrank/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, worked out once: written to a scratch folder and read again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at interpreter exit
        return
