"""Turning rows of bits into lanes of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.functions.bits import row_get


def block_transpose(rows: DataFrame, bits: int, row_id: str = "row_id", words: str = "words", block: int = 64) -> DataFrame:
    """``block, column, lane``: for every ``block`` rows (1 to 64) and bit column, the column's bits, first row highest.

    Rows are numbered from 0 by ``row_id``; a last block that isn't full is left out, as sliced counting does.
    """
    if not 1 <= block <= 64:
        raise ValueError("a lane word holds 1 to 64 rows")
    each = rows.select(F.floor(F.col(row_id) / block).cast("bigint").alias("block"), (F.col(row_id) % block).alias("r"), words).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    put = F.call_function("shiftleft", F.when(row_get(words, F.col("column")), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), (F.lit(block - 1) - F.col("r")).cast("int"))
    return each.groupBy("block", "column").agg(F.bit_or(put).alias("lane"), F.count("*").alias("n")).where(F.col("n") == block).select("block", "column", "lane")
