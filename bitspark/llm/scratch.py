"""Intermediate tables in the folder that all executors share; see ``bitspark.sources.shared``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.sources.shared import cleanup, drop, fresh, shared_dir

__all__ = ["Stored", "cleanup", "drop", "fresh", "shared_dir", "small", "store"]


class Stored:
    """A table written as Parquet, so that later steps reread it and lost executors cost no lineage.

    ``codec`` is for texts worth a slower one; its native buffers add up over many small tasks.
    """

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = fresh(self.spark, name)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Stored(df, name).df


def small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """``df`` to be broadcast if it has ``limit`` rows or fewer, else as it is, to be joined by a shuffle.  For stored tables of narrow rows, whose count is cheap."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
