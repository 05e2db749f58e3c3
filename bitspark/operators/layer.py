"""Applying a layer's filters to rows, and measuring it, in SQL operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.functions.bits import masked_hamming


def apply_layer(rows: DataFrame, dense: DataFrame, thresholds: DataFrame, code: str = "x", outputs: int = 256) -> DataFrame:
    """``rows`` with ``out array<bigint>``: bit ``o`` is whether the masked distance to filter ``o`` exceeds its threshold.

    The filters of a layer become one constant in each row's expression; their number is the layer's width.
    """
    filters = dense.join(thresholds, "o", "right").select("o", "sign", "mask", "threshold").agg(F.array_sort(F.collect_list(F.struct("o", "sign", "mask", "threshold"))).alias("__filters"))
    joined = rows.crossJoin(F.broadcast(filters))  # one row of a fixed size
    bit = F.transform("__filters", lambda f: F.when(F.coalesce(masked_hamming(F.col(code), f["sign"], f["mask"]), F.lit(0)) > f["threshold"], F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    word = lambda bits, w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    made = joined.withColumn("__bits", bit).withColumn("out", F.transform(F.sequence(F.lit(0), F.lit(outputs // 64 - 1)), lambda w: word(F.col("__bits"), w)))
    return made.drop("__filters", "__bits")


def accuracy(decoded: DataFrame, label: str = "label", weight: str = "n", unlabelled: int = 0) -> DataFrame:
    """``correct, total, accuracy``; ``unlabelled`` rows count in the total only.  Without rows the accuracy is null."""
    right = F.sum(F.when(F.col("decoded") == F.col(label), F.col(weight)).otherwise(0)).cast("bigint")
    total = (F.sum(weight) + unlabelled).cast("bigint")
    return decoded.agg(F.coalesce(right, F.lit(0)).alias("correct"), F.coalesce(total, F.lit(unlabelled)).cast("bigint").alias("total")).withColumn("accuracy", F.try_divide(F.col("correct"), F.col("total")))


def sparsity(weights: DataFrame, inputs: int = 512, outputs: int = 256) -> DataFrame:
    """``n_set, sparsity``: used weights, and the share of unused ones."""
    return weights.agg(F.count("*").alias("n_set")).withColumn("sparsity", 1 - F.col("n_set") / (inputs * outputs))
