"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master without one, ``/tmp/checkpoints``."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/bitspark-{sc.applicationId}"


_leaving: set[str] = set()


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet.  What is there still when the driver ends is removed."""
    folder = shared_dir(spark)
    if folder not in _leaving:
        _leaving.add(folder)
        atexit.register(_leave, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _leave(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else Spark was stopped before the driver's end
        drop(spark, folder)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path below the shared folder; one that is gone already is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Remove every table that this application has left; results computed from them must have been read."""
    drop(spark, shared_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and kept if executors are lost."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
