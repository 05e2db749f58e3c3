"""Layers on explicit rows, stacked by hand to any depth.

A row is ``doc_id, pos, x array<bigint>, byte``: 256 bits that stand for the text from ``pos`` on, and the byte
that they should foretell.  ``next_layer`` pairs each row with the one after it, turns the pairs into the next
layer's rows, and moves the target on by one; a row without a follower, or whose byte is missing, ends there.
Collapsed windows (``train_stack``) are faster but hold no more than seven bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.functions.bits import flatten_2d
from bitspark.functions.codes import encode_byte
from bitspark.operators import kernels
from bitspark.operators.model import Model
from bitspark.operators.sequence import utf8_bytes
from bitspark.plans.train import fit_layer, spread
from bitspark.sources.shared import stored


def byte_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The codewords of a text's bytes, each with the byte after it; the last byte has no row."""
    after = F.lead("byte").over(W.partitionBy("doc_id").orderBy("pos"))
    each = utf8_bytes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("after", after).where("after is not null")
    return each.select("doc_id", "pos", encode_byte("byte").alias("x"), F.col("after").alias("byte"))


def paired(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, x, byte`` of twice the width: neighbouring rows side by side, with the byte of the second."""
    order = W.partitionBy("doc_id").orderBy("pos")
    both = rows.select("doc_id", "pos", "x", F.lead("x").over(order).alias("x2"), F.lead("byte").over(order).alias("byte"))
    return both.where("x2 is not null and byte is not null").select("doc_id", "pos", flatten_2d("x", "x2").alias("x"), "byte")


def next_layer(pairs: DataFrame, model: Model) -> DataFrame:
    """The rows of the next layer: the layer's outputs for each of ``paired`` rows, with the shifted byte."""
    return kernels.apply_rows(pairs, model).select("doc_id", "pos", F.col("out").alias("x"), "byte")


def stackable_layer(rows: DataFrame, train: DataFrame | None = None, **options) -> tuple[DataFrame, Model, DataFrame]:
    """``(next rows, model, report)``: fit a layer to ``rows`` (or to ``train`` only) and apply it to all of them.

    The report is one row ``correct, total, accuracy, sparsity``; options are those of ``fit_layer``.
    """
    pairs = stored(paired(rows), "pairs")
    taught = pairs if train is None else stored(paired(train), "taught")
    model, _ = fit_layer(spread(taught.select("x", encode_byte("byte").alias("y"))), kernels.row_reader(), **options)
    made = stored(next_layer(pairs, model), "layer")
    return made, model, accuracy(made, model)


def accuracy(rows: DataFrame, model: Model) -> DataFrame:
    """How many of a layer's rows decode to their byte."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                bits = np.unpackbits(np.stack(pdf["x"].to_numpy()).astype(">i8").view(np.uint8), axis=1)
                yield pd.DataFrame({"right": [int((kernels.decode_bits(bits) == pdf["byte"].to_numpy()).sum())], "n": [len(pdf)]})

    part = rows.select("x", "byte").mapInPandas(run, "right bigint, n bigint").agg(F.coalesce(F.sum("right"), F.lit(0)).alias("correct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return part.select("correct", "total", F.try_divide("correct", "total").alias("accuracy"), F.lit(model.sparsity).alias("sparsity"))
