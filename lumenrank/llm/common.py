"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local folder does for a local master alone; on a cluster it is an error.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints"
    raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenrank/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, so any store works."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at interpreter exit
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. The folder lives until the
    interpreter ends (results are lazy and may be read at any time), or until ``release``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete the scratch folders of materialised tables that nothing will read again."""
    for df in dfs:
        if path := getattr(df, "_scratch_path", None):
            drop_path(df.sparkSession, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write themselves; it lives until the interpreter ends."""
    path = scratch_path(spark, name)
    atexit.register(drop_path, spark, path)
    return path


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of every column of a row, whatever its type; null is told from any value."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        parts += [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c, c.isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second half"), *parts)


def word_count(text: Column) -> Column:
    """Words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def power_of_two(rows: int, per_bucket: int) -> int:
    """Bits of a bucket count that keeps about ``per_bucket`` rows in a bucket."""
    return max(0, (max(1, rows) // per_bucket).bit_length())
