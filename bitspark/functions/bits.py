"""Bit words and bit rows as columns.

A word is a ``bigint`` read as 64 unsigned bits; a row is an array of words.  Index 0 is the most
significant bit of the first word, unless a name says ``lsb``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitspark.functions.util import as_col

ZERO = 0


def count_ones(word: Column | str) -> Column:
    return F.bit_count(as_col(word)).cast("int")


def get_bit(word: Column | str, i: Column | int) -> Column:
    return get_bit_u8(word, i) == 1


def get_bit_u8(word: Column | str, i: Column | int) -> Column:
    return F.bit_get(as_col(word), (F.lit(63) - as_col(i)).cast("int")).cast("int")


def _one_at(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(63) - i).cast("int"))


def set_bit(word: Column | str, i: Column | int, value: Column | bool) -> Column:
    """The word with bit ``i`` cleared and then set to ``value``."""
    at = _one_at(as_col(i))
    cleared = as_col(word).bitwiseAND(F.bitwise_not(at))
    return F.when(as_col(value), cleared.bitwiseOR(at)).otherwise(cleared)


def display(word: Column | str) -> Column:
    """All 64 binary digits."""
    return F.lpad(F.bin(as_col(word)), 64, "0")


def row_get(row: Column | str, i: Column | int) -> Column:
    i = as_col(i)
    return get_bit(F.get(as_col(row), F.floor(i / 64).cast("int")), i % 64)


def row_set(row: Column | str, i: Column | int, value: Column | bool) -> Column:
    i = as_col(i)
    return F.transform(as_col(row), lambda w, k: F.when(k == F.floor(i / 64), set_bit(w, i % 64, value)).otherwise(w))


def lsb_get(value: Column | str, b: Column | int) -> Column:
    """Bit ``b`` of an integer counted from the least significant; used on candidate masks."""
    return F.bit_get(as_col(value).cast("bigint"), as_col(b).cast("int")) == 1


def lsb_or(row: Column | str, y: Column | int, value: Column | bool) -> Column:
    """The row with bit ``y`` of the code order (least significant first within a word) or-ed in; it never clears."""
    y = as_col(y)
    put = F.call_function("shiftleft", F.when(as_col(value), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), (y % 64).cast("int"))
    return F.transform(as_col(row), lambda w, k: F.when(k == F.floor(y / 64), w.bitwiseOR(put)).otherwise(w))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two rows of equal width differ."""
    return _sum(F.zip_with(as_col(a), as_col(b), lambda x, y: count_ones(x.bitwiseXOR(y))))


def masked_hamming(row: Column | str, sign: Column | str, mask: Column | str) -> Column:
    """Ones of ``(row XOR sign) AND mask``."""
    flipped = F.zip_with(as_col(row), as_col(sign), lambda x, s: x.bitwiseXOR(s))
    return _sum(F.zip_with(flipped, as_col(mask), lambda x, m: count_ones(x.bitwiseAND(m))))


def set_trit(sign: Column | str, mask: Column | str, i: Column | int, value: Column | bool) -> Column:
    """Struct ``sign, mask`` with input ``i`` used, negated if ``value``."""
    return F.struct(row_set(sign, i, value).alias("sign"), row_set(mask, i, F.lit(True)).alias("mask"))


def flatten_2d(*rows: Column | str) -> Column:
    """Rows one after the other."""
    return F.concat(*[as_col(r) for r in rows])
