"""Lane logic and arithmetic of P-bit unsigned integers.

A lane is an array of words, one bit for each example.  The integers that other engines keep as bit planes
are plain integers here; ``planes`` and ``from_planes`` give the sliced form, least significant first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitspark.functions.bits import count_ones
from bitspark.functions.util import as_col


def zeros(words: int) -> Column:
    return F.array(*[F.lit(0).cast("bigint")] * words)


def ones(words: int) -> Column:
    return F.array(*[F.lit(-1).cast("bigint")] * words)


def splat(flag: Column | bool, words: int = 1) -> Column:
    """A lane of ``words`` words with every bit equal to ``flag``."""
    return F.array_repeat(F.when(as_col(flag), F.lit(-1)).otherwise(F.lit(0)).cast("bigint"), words)


def lane_xor(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x.bitwiseXOR(y))


def lane_and(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x.bitwiseAND(y))


def lane_or(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x.bitwiseOR(y))


def lane_not(a: Column | str) -> Column:
    return F.transform(as_col(a), lambda x: F.bitwise_not(x))


def lane_count(a: Column | str) -> Column:
    return F.aggregate(F.transform(as_col(a), count_ones), F.lit(0), lambda s, x: s + x)


def half_adder(a: Column, b: Column) -> Column:
    """Of lanes: struct ``sum, carry``."""
    return F.struct(lane_xor(a, b).alias("sum"), lane_and(a, b).alias("carry"))


def full_adder(a: Column, b: Column, c: Column) -> Column:
    u = lane_xor(a, b)
    return F.struct(lane_xor(u, c).alias("sum"), lane_or(lane_and(a, b), lane_and(u, c)).alias("carry"))


def half_comparator(a: Column, b: Column) -> Column:
    """Of lanes: struct ``lt, eq, gt``, a bit for each example."""
    lt, gt = lane_and(lane_not(a), b), lane_and(a, lane_not(b))
    return F.struct(lt.alias("lt"), lane_not(lane_or(lt, gt)).alias("eq"), gt.alias("gt"))


def full_comparator(a: Column, b: Column, lower: Column) -> Column:
    """Compare a more significant plane, given the result of the planes below."""
    x = half_comparator(a, b)
    lt = lane_or(x["lt"], lane_and(lane_not(x["gt"]), lower["lt"]))
    gt = lane_or(x["gt"], lane_and(lane_not(x["lt"]), lower["gt"]))
    return F.struct(lt.alias("lt"), lane_not(lane_or(lt, gt)).alias("eq"), gt.alias("gt"))


def _modulus(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("bigint")


def number(value: Column | int, bits: int) -> Column:
    """A constant or column as a ``bits``-bit integer: reduced modulo 2**bits."""
    return as_col(value).cast("bigint").bitwiseAND(_modulus(bits))


def add(a: Column | str, b: Column | str) -> Column:
    """Sum of two integers, one bit wider than they are."""
    return as_col(a) + as_col(b)


def add_wrapping(a: Column | str, b: Column | str, bits: int) -> Column:
    """Sum modulo 2**bits."""
    return (as_col(a) + as_col(b)).bitwiseAND(_modulus(bits))


def compare(a: Column | str, b: Column | str) -> Column:
    """Struct ``lt, eq, gt`` of two unsigned integers."""
    a, b = as_col(a), as_col(b)
    return F.struct((a < b).alias("lt"), (a == b).alias("eq"), (a > b).alias("gt"))


def equality(a: Column | str, b: Column | str) -> Column:
    """Whether all bits agree."""
    return as_col(a) == as_col(b)


def planes(value: Column | str, bits: int) -> Column:
    """Bits of an integer, least significant first."""
    v = as_col(value)
    return F.array(*[F.bit_get(v.cast("bigint"), F.lit(k)).cast("int") for k in range(bits)])


def extend(plane_array: Column | str, bits: int) -> Column:
    """Planes padded with zero planes; more planes than ``bits`` can't be narrowed and are an error."""
    p = as_col(plane_array)
    padded = F.concat(p, F.array_repeat(F.lit(0), F.greatest(F.lit(bits) - F.size(p), F.lit(0))))
    return F.when(F.size(p) <= bits, padded).otherwise(F.raise_error(F.lit("extend: more planes than the target holds")))


def from_planes(plane_array: Column | str) -> Column:
    return F.aggregate(F.reverse(as_col(plane_array)), F.lit(0).cast("bigint"), lambda s, b: s * 2 + b)
