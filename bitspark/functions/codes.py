"""Hadamard codewords of bytes.

Bit ``y`` of the codeword of ``x`` is the parity of ``x AND (y + offset)``.  In a row of words, bit ``y`` is
counted from the least significant of word ``y // 64``; its index in the most-significant-first order that
everything else uses is ``code_index(y)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.functions.bits import hamming
from bitspark.functions.util import as_col

#: Kind of codebook: (number of bits, offset).
KINDS = {"full": (256, 0), "thin": (128, 128), "wide": (512, 0)}


def code_index(y):
    """Most-significant-first index of code bit ``y``; its own inverse.  For integers and for columns."""
    if isinstance(y, Column):
        return (F.floor(y / 64) * 64 + 63 - y % 64).cast("int")
    return y // 64 * 64 + 63 - y % 64


def parity(x: Column) -> Column:
    return (F.bit_count(x) % 2).cast("int")


def code_bit(byte: Column | str, i: Column | int, kind: str = "full") -> Column:
    """Bit at most-significant-first index ``i`` of a byte's codeword, 0 or 1."""
    y = code_index(as_col(i) + 0)
    return parity(as_col(byte).cast("bigint").bitwiseAND((y + KINDS[kind][1]).cast("bigint")))


def _constant(kind: str) -> Column:
    """All codewords as one constant array of rows; no word of a codeword is the least bigint, which has no literal."""
    return F.expr(f"array({', '.join('array(' + ', '.join(f'{w}L' for w in row) + ')' for row in code_table(kind).tolist())})")


def encode_byte(byte: Column | str, kind: str = "full") -> Column:
    """Codeword of a byte (0 to 255) as a row of words, by place in the constant codebook."""
    return F.get(_constant(kind), as_col(byte).cast("int"))


def codebook(spark: SparkSession, kind: str = "full") -> DataFrame:
    """``byte int, code array<bigint>``: all 256 codewords."""
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), encode_byte("id", kind).alias("code"))


def decode(rows: DataFrame, code: str = "code", kind: str = "full") -> DataFrame:
    """``rows`` with ``decoded int, distance int``: the byte of the nearest codeword, the smallest of several.

    The 256 codewords are a constant array in the plan, so nothing is joined and each row is decoded where it is.
    """
    table = _constant(kind)
    found = F.array_min(F.transform(table, lambda c, k: F.struct(hamming(F.col(code), c).alias("distance"), k.cast("int").alias("byte"))))
    return rows.withColumn("__d", found).select("*", F.col("__d.byte").alias("decoded"), F.col("__d.distance").alias("distance")).drop("__d")


def code_bits(kind: str = "full") -> np.ndarray:
    """All codewords as 0/1, one row a byte, most significant first."""
    bits, offset = KINDS[kind]
    y = code_index(np.arange(bits)) + offset
    return (np.bitwise_count(np.arange(256)[:, None] & y[None, :]) & 1).astype(np.uint8)


def code_table(kind: str = "full") -> np.ndarray:
    """All codewords as signed words."""
    return np.packbits(code_bits(kind), axis=1).view(">i8").astype(np.int64)
