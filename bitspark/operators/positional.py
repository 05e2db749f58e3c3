"""Rows by their place: dense numbers in an order, and zipping two tables by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.sources.shared import stored


def numbered(rows: DataFrame, order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """``number bigint, row struct``: every row with its place in ``order``, from 0 without gaps.

    Rows are dealt to ranges of the order and sorted there, which gives each its place in its range; how many rows the
    ranges before hold is a running sum over a row for each range.  Among equal rows places are dealt in any way,
    and stay so for what reads the result.  Null keys come where Spark's sorting puts them.
    """
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    # the low 33 bits of the id count the rows of a partition
    placed = stored(packed.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", (F.sum("size").over(W.orderBy("range")) - F.col("size")).alias("before"))  # a row for each range
    return placed.join(F.broadcast(before), "range").select((F.col("before") + F.col("at")).alias("number"), "row")


def zipped(left: DataFrame, left_order: list[Column | str], right: DataFrame, right_order: list[Column | str]) -> DataFrame:
    """``number, left struct, right struct``: the k-th row of one table beside the k-th of the other, as far as both go."""
    a = numbered(left, left_order).withColumnRenamed("row", "left")
    b = numbered(right, right_order).withColumnRenamed("row", "right")
    return a.join(b, "number")


def enumerated(rows: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``rows`` with the column ``name``, its place in ``order``."""
    return numbered(rows, order).select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c != name], F.col("number").alias(name))


def chunks(rows: DataFrame, order: list[Column | str], size: int, rest: bool = True) -> DataFrame:
    """``chunk bigint, place int, row struct``: runs of ``size`` rows in ``order``; without ``rest`` a last one that isn't full is left out."""
    if size < 1:
        raise ValueError("a chunk has one row or more")
    every = numbered(rows, order)
    if not rest:
        total = every.agg(F.count("*").alias("n")).first()["n"]
        every = every.where(F.col("number") < total // size * size)
    return every.select(F.floor(F.col("number") / size).cast("bigint").alias("chunk"), (F.col("number") % size).cast("int").alias("place"), "row")
