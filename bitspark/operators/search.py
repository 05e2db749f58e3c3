"""The greedy search over counts: which candidates to try together, and which of them to keep.

Every tie has its own rule.  Of a feature's signs the negated wins; of features, the lower number; of
thresholds, the lowest; of masks, the one with fewer candidates, and then the larger number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exp_candidates(counts: DataFrame, weights: DataFrame, n_candidates: int = 7) -> DataFrame:
    """``o, slot, i, s``: the unused features with the highest counts, each at its better sign, best first."""
    free = counts.join(F.broadcast(weights.select("o", "i")), ["o", "i"], "left_anti")
    by_sign = free.groupBy("o", "i", "s").agg(F.max("count").alias("count"))
    best = by_sign.groupBy("o", "i").agg(F.max(F.struct("count", "s")).alias("x")).select("o", "i", "x.count", "x.s")
    rank = F.row_number().over(W.partitionBy("o").orderBy(F.col("count").desc(), F.col("i").asc()))
    return best.withColumn("slot", (rank - 1).cast("int")).where(F.col("slot") < n_candidates).select("o", "slot", "i", "s")


def require_candidates(candidates: DataFrame, n_candidates: int) -> None:
    """Raise if a filter has fewer unused features than candidates are asked for."""
    short = candidates.groupBy("o").count().where(F.col("count") < n_candidates).limit(1).collect()
    if short:
        raise ValueError(f"output {short[0]['o']} has only {short[0]['count']} unused features; {n_candidates} candidates are asked for")


def choose(counts: DataFrame, weights: DataFrame, thresholds: DataFrame, capacity_bits: int = 4) -> DataFrame:
    """``o, mask, accuracy, threshold``: the winning mask and threshold of each output.

    Masks that would bring a filter to ``2**capacity_bits`` weights or more are out.
    """
    base = thresholds.select("o", F.col("threshold").alias("base"))
    at = counts.join(F.broadcast(base), "o").withColumn("threshold", F.col("base") + F.col("t"))
    masks = at.groupBy("o", "mask").agg(F.max(F.struct("count", (-F.col("threshold")).alias("low"))).alias("x"))
    n_set = weights.groupBy("o").agg(F.count("*").alias("n_set"))
    fits = masks.join(F.broadcast(n_set), "o", "left").where(F.bit_count("mask") + F.coalesce("n_set", F.lit(0)) < (1 << capacity_bits))
    key = F.struct(F.col("x.count").alias("count"), (-F.bit_count("mask")).alias("few"), "mask", F.col("x.low").alias("low"))
    return fits.groupBy("o").agg(F.max(key).alias("x")).select("o", F.col("x.mask").alias("mask"), F.col("x.count").alias("accuracy"), (-F.col("x.low")).cast("int").alias("threshold"))


def update_filters(chosen: DataFrame, candidates: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``weights`` and ``thresholds``: the chosen slots join the filter, the others stay unused."""
    picked = candidates.join(F.broadcast(chosen), "o").where(F.bit_get(F.col("mask").cast("bigint"), F.col("slot")) == 1)
    return weights.select("o", "i", "s").union(picked.select("o", "i", "s")), chosen.select("o", "threshold")
