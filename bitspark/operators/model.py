"""Filters: sparse ternary weights and thresholds, as small tables and as arrays.

The long form is ``weights(o, i, s)`` (output, input, 1 if the input is negated) and ``thresholds(o,
threshold)``.  ``Model`` holds the same as arrays for the kernels; its size depends on the shape of a
layer, never on the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUTS, OUTPUTS = 512, 256
#: Fixed values of the test filters: multiples of the output's number that are used, and whether an even output negates there.
STEPS = ((1, True), (2, True), (3, False), (5, True), (7, False), (11, True))


@dataclass
class Model:
    """``weight[o, i]``: -1 unset, 0 plain, 1 negated; ``threshold[o]``."""

    weight: np.ndarray
    threshold: np.ndarray

    @classmethod
    def empty(cls, inputs: int = INPUTS, outputs: int = OUTPUTS) -> Model:
        return cls(np.full((outputs, inputs), -1, np.int8), np.zeros(outputs, np.int64))

    @property
    def n_set(self) -> np.ndarray:
        return (self.weight >= 0).sum(1)

    @property
    def sparsity(self) -> float:
        return float((self.weight < 0).mean())

    def to_tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        o, i = np.nonzero(self.weight >= 0)
        rows = [(int(a), int(b), int(self.weight[a, b])) for a, b in zip(o, i, strict=True)]
        return spark.createDataFrame(rows, "o int, i int, s int"), spark.createDataFrame([(k, int(t)) for k, t in enumerate(self.threshold)], "o int, threshold int")

    @classmethod
    def from_tables(cls, weights: DataFrame, thresholds: DataFrame, inputs: int = INPUTS, outputs: int = OUTPUTS) -> Model:
        out = cls.empty(inputs, outputs)
        for r in weights.collect():  # a layer's filters: at most inputs x outputs rows
            out.weight[r["o"], r["i"]] = r["s"]
        for r in thresholds.collect():
            out.threshold[r["o"]] = r["threshold"]
        return out


def test_filters(spark: SparkSession, outputs: list[int] | None = None, inputs: int = INPUTS) -> DataFrame:
    """``o, i, s`` of the fixed filters: six multiples of ``o`` modulo ``inputs``; where two fall together the later counts.  Their thresholds are 1."""
    base = spark.range(OUTPUTS).select(F.col("id").cast("int").alias("o"))
    if outputs is not None:
        base = base.where(F.col("o").isin(outputs))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(int(e)).alias("e")) for k, (m, e) in enumerate(STEPS)])
    each = base.withColumn("x", F.explode(steps)).select("o", (F.col("o") * F.col("x.m") % inputs).alias("i"), F.col("x.k").alias("k"), F.when(F.col("o") % 2 == 0, F.col("x.e")).otherwise(1 - F.col("x.e")).alias("s"))
    return each.groupBy("o", "i").agg(F.max(F.struct("k", "s")).alias("x")).select("o", "i", F.col("x.s").alias("s"))


def sparse_weights(weights: DataFrame, thresholds: DataFrame, n_thresholds: int = 2) -> DataFrame:
    """``o, terms array<struct<i,s>>, thresholds array<int>``: used inputs in order, and the thresholds that are tried."""
    terms = weights.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("terms"))
    empty = F.array().cast("array<struct<i:int,s:int>>")
    return thresholds.join(terms, "o", "left").select("o", F.coalesce("terms", empty).alias("terms"), threshold_range("threshold", n_thresholds).alias("thresholds"))


def threshold_range(base, n: int):
    """``n`` thresholds from ``base`` on."""
    base = F.col(base) if isinstance(base, str) else base
    return F.sequence(base.cast("int"), base.cast("int") + n - 1)


def dense_weights(weights: DataFrame, inputs: int = INPUTS) -> DataFrame:
    """``o, sign array<bigint>, mask array<bigint>``: a filter as two rows of words."""
    at = F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - F.col("i") % 64).cast("int"))
    words = weights.groupBy("o", F.floor(F.col("i") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.when(F.col("s") == 1, at).otherwise(F.lit(0).cast("bigint"))).alias("sign"), F.bit_or(at).alias("mask")
    )
    whole = words.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("sign", "mask")))).alias("m"))
    pick = lambda name: F.transform(F.sequence(F.lit(0), F.lit(inputs // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w.cast("int"))[name], F.lit(0).cast("bigint")))
    return whole.select("o", pick("sign").alias("sign"), pick("mask").alias("mask"))
