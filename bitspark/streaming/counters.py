"""Window counts over a stream of texts.  Counts are additive: a micro-batch's counts join those so far."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bitspark.operators.sequence import code_type, distinct_windows


def count_windows(stream: DataFrame, width: int, sink: str, checkpoint: str, column: str = "text") -> StreamingQuery:
    """Write each micro-batch's distinct windows below ``sink``, a folder for each batch.

    A batch that is tried again replaces its own folder, so every text counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        distinct_windows(batch, width, column).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, sink: str) -> dict[str, list[int]]:
    """Numbers of the complete folders ``upto=N`` (all batches up to N put together) and ``batch=N``, in order."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"upto": [], "batch": []}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        m = re.fullmatch(r"(upto|batch)=(\d+)", status.getPath().getName())
        if m and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[m[1]].append(int(m[2]))
    return {k: sorted(v) for k, v in out.items()}


def windows_so_far(spark: SparkSession, sink: str, width: int) -> DataFrame:
    """``code, n`` over all batches that have ended: the last that were put together, and those since."""
    found = _folders(spark, sink)
    last = found["upto"][-1] if found["upto"] else -1
    paths = [f"{sink}/upto={last}"] * (last >= 0) + [f"{sink}/batch={k}" for k in found["batch"] if k > last]
    rows = spark.createDataFrame([], f"code {code_type(width)}, n bigint")
    if paths:
        rows = spark.read.schema(rows.schema).parquet(*paths)
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, sink: str, width: int) -> None:
    """Put all batches so far together, so that reading doesn't grow with their number.

    The sum is complete before anything goes; readers take the newest sum and the batches after it, and a run that
    was lost on its way is done again.  One at a time.
    """
    found = _folders(spark, sink)
    if len(found["batch"]) + len(found["upto"]) < 2:
        return
    last = max(found["batch"] + found["upto"])
    if last not in found["upto"]:
        windows_so_far(spark, sink, width).write.mode("overwrite").parquet(f"{sink}/upto={last}")
    sc = spark.sparkContext
    for kind, numbers in found.items():
        for k in numbers:
            if kind == "batch" and k <= last or kind == "upto" and k < last:
                gone = sc._jvm.org.apache.hadoop.fs.Path(f"{sink}/{kind}={k}")
                gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
