"""The two counting aggregations, as joins and hash aggregates over first-layer contexts.

Every count is the number of rows whose predicted bit equals the target bit.  Rows enter only through
small contingency tables: for unit counts (base sum, target, byte) by output, for exp counts (base sum,
pattern of candidate bits, target) by output.  A first-layer feature depends on one byte alone, so each
half of the features needs the contingency of its own byte only, and no row meets 512 features.

``modulus_bits`` P makes sums and thresholds P-bit integers that wrap around; None counts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitspark.functions.codes import code_bit

HALF = 256


def _wrap(c: Column, bits: int | None) -> Column:
    return c if bits is None else c.bitwiseAND(F.lit((1 << bits) - 1))


def _bit(byte: Column, i: Column) -> Column:
    return code_bit(byte, i % HALF)


def _per_byte(terms: DataFrame, value: Column, half: int, name: str) -> DataFrame:
    """``o, b{half}, name``: sum of ``value`` over a filter's terms in one half of the features, for each byte that the half can hold."""
    mine = terms.where((F.col("i") >= half * HALF) & (F.col("i") < (half + 1) * HALF))
    every = mine.withColumn(f"b{half}", F.explode(F.sequence(F.lit(0), F.lit(255))))
    flipped = _bit(F.col(f"b{half}"), F.col("i")).bitwiseXOR(F.col("s"))
    return every.groupBy("o", f"b{half}").agg(F.sum(value(flipped)).cast("int").alias(name))


def _both_halves(rows: DataFrame, terms: DataFrame, value, name: str) -> DataFrame:
    for half in (0, 1):
        rows = rows.join(F.broadcast(_per_byte(terms, value, half, f"__{name}{half}")), ["o", f"b{half}"], "left")
    total = F.coalesce(f"__{name}0", F.lit(0)) + F.coalesce(f"__{name}1", F.lit(0))
    return rows.withColumn(name, total).drop(f"__{name}0", f"__{name}1")


def base_sums(contexts: DataFrame, weights: DataFrame, outputs: list[int], modulus_bits: int | None) -> DataFrame:
    """``o, b0, b1, y, n, c``: for each output and context the sum over the filter so far and the target bit.

    ``contexts(b0, b1, b2, n)`` are two bytes, the byte to predict and a count.  The broadcast tables hold
    a value for each output and byte, whatever the data.
    """
    rows = contexts.withColumn("o", F.explode(F.array(*[F.lit(o) for o in outputs])))
    rows = _both_halves(rows, weights, lambda x: x, "c").withColumn("c", _wrap(F.col("c"), modulus_bits))
    return rows.select("o", "b0", "b1", code_bit("b2", F.col("o")).alias("y"), "n", "c")


def _agree(value: Column, threshold: Column, y: Column, bits: int | None) -> Column:
    return (value > _wrap(threshold, bits)).cast("int") == y


def unit_counts(base: DataFrame, weights: DataFrame, thresholds: DataFrame, n_thresholds: int = 2, modulus_bits: int | None = None) -> DataFrame:
    """``o, i, s, t, count``: rows right if feature ``i`` with sign ``s`` joined the filter, at threshold number ``t``.

    Counts of features that the filter uses already are 0.
    """
    halves = []
    for half in (0, 1):
        small = base.groupBy("o", "c", "y", F.col(f"b{half}").alias("b")).agg(F.sum("n").alias("n"))
        each = small.withColumn("i", F.explode(F.sequence(F.lit(half * HALF), F.lit((half + 1) * HALF - 1))))
        halves.append(each.groupBy("o", "i", "c", "y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * _bit(F.col("b"), F.col("i"))).alias("n1")))
    table = halves[0].union(halves[1])
    sign = F.explode(F.array(F.lit(0), F.lit(1)))
    tries = table.withColumn("s", sign).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1)))).join(F.broadcast(thresholds), "o")
    limit = F.col("threshold") + F.col("t")
    right = F.lit(0).cast("bigint")
    for x, n in ((0, F.col("n") - F.col("n1")), (1, F.col("n1"))):
        value = _wrap(F.col("c") + F.lit(x).bitwiseXOR(F.col("s")), modulus_bits)
        right = right + F.when(_agree(value, limit, F.col("y"), modulus_bits), n).otherwise(F.lit(0))
    counts = tries.groupBy("o", "i", "s", "t").agg(F.sum(right).alias("count"))
    used = F.broadcast(weights.select("o", "i", F.lit(True).alias("used")))
    return counts.join(used, ["o", "i"], "left").select("o", "i", "s", "t", F.when(F.col("used"), F.lit(0)).otherwise(F.col("count")).cast("bigint").alias("count"))


def patterns(contexts: DataFrame, weights: DataFrame, candidates: DataFrame, outputs: list[int], modulus_bits: int | None) -> DataFrame:
    """``o, c, pattern, y, n``: contexts collapsed to base sum, the candidates' signed bits (slot 0 lowest) and target."""
    rows = contexts.withColumn("o", F.explode(F.array(*[F.lit(o) for o in outputs])))
    rows = _both_halves(rows, weights, lambda x: x, "c").withColumn("c", _wrap(F.col("c"), modulus_bits))
    rows = _both_halves(rows, candidates, lambda x: F.call_function("shiftleft", x, F.col("slot")), "pattern")
    return rows.groupBy("o", "c", "pattern", code_bit("b2", F.col("o")).alias("y")).agg(F.sum("n").alias("n"))


def exp_counts(table: DataFrame, thresholds: DataFrame, n_candidates: int = 7, n_thresholds: int = 3, modulus_bits: int | None = None) -> DataFrame:
    """``o, mask, t, count``: rows right if the candidates in ``mask`` joined the filter, at threshold number ``t``."""
    tries = (
        table.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n_candidates) - 1))))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))))
        .join(F.broadcast(thresholds), "o")
    )
    value = _wrap(F.col("c") + F.bit_count(F.col("pattern").bitwiseAND(F.col("mask"))), modulus_bits)
    right = F.when(_agree(value, F.col("threshold") + F.col("t"), F.col("y"), modulus_bits), F.col("n")).otherwise(F.lit(0))
    return tries.groupBy("o", "mask", "t").agg(F.sum(right).cast("bigint").alias("count"))


def whole_lanes(rows: DataFrame, lane: int, row_id: str = "row_id") -> DataFrame:
    """The rows that sliced counting with lanes of ``lane`` rows counts: rows numbered from 0 up to the last whole lane, without the remainder."""
    if lane < 1:
        raise ValueError("a lane holds one row or more")
    n = rows.agg(F.count_distinct(F.col(row_id))).first()[0]
    return rows.where(F.col(row_id) < n // lane * lane)


def unit_counts_of_bits(features: DataFrame, targets: DataFrame, weights: DataFrame, thresholds: DataFrame, n_thresholds: int = 2, modulus_bits: int | None = None) -> DataFrame:
    """Unit counts of any bits in long form: ``features(row, i, x)`` and ``targets(row, o, y)``."""
    base = targets.join(features.join(F.broadcast(weights), "i").groupBy("row", "o").agg(F.sum(F.col("x").bitwiseXOR(F.col("s"))).alias("b")), ["row", "o"], "left")
    base = base.select("row", "o", "y", _wrap(F.coalesce("b", F.lit(0)), modulus_bits).alias("c"))
    table = base.join(features, "row").groupBy("o", "i", "c", "y").agg(F.count("*").alias("n"), F.sum("x").alias("n1"))
    tries = table.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1)))).join(F.broadcast(thresholds), "o")
    right = F.lit(0).cast("bigint")
    for x, n in ((0, F.col("n") - F.col("n1")), (1, F.col("n1"))):
        value = _wrap(F.col("c") + F.lit(x).bitwiseXOR(F.col("s")), modulus_bits)
        right = right + F.when(_agree(value, F.col("threshold") + F.col("t"), F.col("y"), modulus_bits), n).otherwise(F.lit(0))
    counts = tries.groupBy("o", "i", "s", "t").agg(F.sum(right).alias("count"))
    used = F.broadcast(weights.select("o", "i", F.lit(True).alias("used")))
    return counts.join(used, ["o", "i"], "left").select("o", "i", "s", "t", F.when(F.col("used"), F.lit(0)).otherwise(F.col("count")).cast("bigint").alias("count"))
