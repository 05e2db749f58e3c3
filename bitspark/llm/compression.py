"""Quality by compression.

Two zstandard dictionaries are built, from blocks of texts that labels call good and from blocks of bad ones.  A
text is cut into blocks, each compressed with either dictionary and with none; the text is as good as the good
dictionary makes it smaller than the bad one does.  That difference, normalised by the text's size and by the
size without a dictionary, and how well the text compresses by itself (words said over and over need no
dictionary), are calibrated by logistic regression to the chance of a good label.

Blocks are of fixed size, so that a long text counts as much as all of it, not only as its start, and a task
holds a block at a time.  What is fitted are bounded samples of labelled rows; every text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored

BLOCK_BYTES = 2048
DICTIONARY_BYTES = 114_688
LEVEL = 3
SIZES = "good boolean, bytes bigint, by_bad bigint, by_good bigint, plain bigint"
BLOCKS = "half int, good boolean, block binary"


@dataclass(frozen=True)
class Fit:
    """Dictionaries of bad and good text, and the weights of the calibration; empty ``weights`` give everything ``prior``."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -40, 40)))


def blocks(raw: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    return (raw[k : k + size] for k in range(0, len(raw), size))


class Sizes:
    """Compressed sizes of a text's blocks with the bad, the good and no dictionary."""

    def __init__(self, bad: bytes, good: bytes):
        frame = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = [zstandard.ZstdCompressor(dict_data=_ready(d), **frame) for d in (bad, good)] + [zstandard.ZstdCompressor(**frame)]

    def of(self, raw: bytes) -> tuple[int, int, int]:
        total = [0, 0, 0]
        for block in blocks(raw):
            for k, c in enumerate(self.by):
                total[k] += len(c.compress(block))
        return total[0], total[1], total[2]


def _ready(raw: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(raw)
    made.precompute_compress(level=LEVEL)
    return made


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on ``samples``, or their last ``size`` bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def features(size: np.ndarray, by_bad: np.ndarray, by_good: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """One, the difference by bytes and by plain compressed size, and the log of the plain rate; an empty text has a rate of 1 and no difference."""
    n, p = np.maximum(size, 1).astype(float), np.maximum(plain, 1).astype(float)
    difference = by_bad - by_good
    return np.stack((np.ones(len(n)), difference / n, difference / p, np.log(p / n)), axis=1)


def calibrate(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a light ridge on scaled features."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    w[0] = math.log((good.sum() + 0.5) / ((~good).sum() + 0.5))

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.logaddexp(0, np.where(good, -m, m)).sum() + ridge * v @ v / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (good - p) - ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        after, reach = loss(w + step), 1.0
        while after > now and reach > 1e-6:  # never uphill, so that separable classes don't diverge
            reach /= 2
            after = loss(w + reach * step)
        if now - after < 1e-9:
            break
        w, now = w + reach * step, after
    return w / scale


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of five; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def told(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of the ids that are in ``docs`` once, whose labels all say 0 or all say 1, and that aren't held out."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    sure = rows.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    return docs.groupBy("doc_id").count().where("count = 1").select("doc_id").join(sure, "doc_id")


def picks(known: DataFrame, rows: int) -> DataFrame:
    """``doc_id, good, half, at`` of at most ``rows`` ids of each class and half: those of the least hash, of about a fifth more that a share lets through."""
    mixed = known.withColumn("at", F.xxhash64("doc_id")).withColumn("half", F.pmod(F.shiftright("at", 7), F.lit(2)).cast("int"))
    counts = F.broadcast(mixed.groupBy("good", "half").agg(F.count("*").alias("n")))  # four rows
    some = mixed.join(counts, ["good", "half"]).where(F.pmod(F.col("at"), F.lit(1 << 30)) <= 1.2 * rows / F.col("n") * (1 << 30))
    return some.withColumn("r", F.row_number().over(W.partitionBy("good", "half").orderBy("at", "doc_id"))).where(F.col("r") <= rows).select("doc_id", "good", "half", "at")


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 2000, sample_blocks: int = 2000) -> Fit:
    """Dictionaries and calibration from ``docs(doc_id, raw)`` and ``labels(doc_id, quality)``.

    At most ``rows`` labelled ids of each class and half are taken, and of their texts at most ``sample_blocks`` blocks of
    each class and half reach the driver, which trains the dictionaries.  Each half is measured with
    dictionaries of the other, so that the calibration sees differences as they are on new texts; the final dictionaries
    are of both.  Without labels of both classes the score is the share of good labels, or 0.5.
    """
    known = Stored(told(docs, labels), "known").df
    chosen = Stored(picks(known, rows), "picks").df
    # at most 4 * rows ids, each of one document
    texts = Stored(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "half", "at", "raw"), "sample").df
    counts = {(r["half"], r["good"]): r["n"] for r in texts.groupBy("half", "good").agg(F.sum(F.ceil(F.octet_length("raw") / BLOCK_BYTES)).alias("n")).collect()}
    share = {k: min(1.0, 0.95 * sample_blocks / max(1, n)) for k, n in counts.items()}  # of the blocks, to take a little less than sample_blocks

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for half, good, at, raw in zip(batch["half"], batch["good"], batch["at"], batch["raw"], strict=True):
                n = -(-len(raw) // BLOCK_BYTES)
                taken = np.flatnonzero(np.random.default_rng(at & (1 << 63) - 1).random(n) < share[half, good])
                if len(taken):
                    yield pd.DataFrame({"half": half, "good": good, "block": [raw[k * BLOCK_BYTES : (k + 1) * BLOCK_BYTES] for k in taken.tolist()]})

    kept = texts.select("half", "good", "at", "raw").mapInPandas(cut, BLOCKS)
    rank = F.row_number().over(W.partitionBy("half", "good").orderBy(F.xxhash64("block"), "block"))
    found = kept.withColumn("r", rank).where(F.col("r") <= sample_blocks).orderBy("half", "good", "r").collect()
    samples: dict[tuple[int, bool], list[bytes]] = {(h, g): [] for h in (0, 1) for g in (False, True)}
    for r in found:
        samples[r["half"], r["good"]].append(bytes(r["block"]))
    pool = [samples[0, g] + samples[1, g] for g in (False, True)]
    if not pool[0] or not pool[1]:
        prior = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
        return Fit(b"", b"", (), 0.5 if prior is None else prior)
    other = [tuple(dictionary(samples[1 - h, g] or pool[g]) for g in (False, True)) for h in (0, 1)]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = [Sizes(*d) for d in other]
        for batch in batches:
            out = [(good, len(raw), *by[half].of(raw)) for half, good, raw in zip(batch["half"], batch["good"], batch["raw"], strict=True)]
            yield pd.DataFrame(out, columns=["good", "bytes", "by_bad", "by_good", "plain"])

    # a few numbers of each sampled row, put in order so that sums of floats come out alike
    table = np.array(sorted(tuple(r) for r in texts.select("half", "good", "raw").mapInPandas(measured, SIZES).collect()))
    weights = calibrate(features(*table[:, 1:].T), table[:, 0].astype(bool))
    return Fit(dictionary(pool[0]), dictionary(pool[1]), tuple(weights.tolist()), 0.5)


def scores(docs: DataFrame, model: Fit) -> DataFrame:
    """``docs(doc_id, held_out, raw)`` -> ``doc_id, held_out, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Sizes(model.bad, model.good) if model.weights else None
        for batch in batches:
            raws = batch.column("raw")
            found = [(len(raw), *(by.of(raw) if by else (0, 0, 0))) for raw in (x.as_py() for x in raws)]
            score = model.score(features(*np.array(found, np.int64).reshape(-1, 4).T))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.3, rows: int = 2000, sample_blocks: int = 2000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the chance that its label would be 1, and ``predicted`` whether that is ``least`` or more.  Only
    labels of ids that aren't held out are learned from (see ``held_out``), in samples that ``fit`` bounds; an id
    that several documents have or whose labels differ teaches nothing.  A null text is empty; an empty text compresses to nothing and is
    scored as one without any difference.  A null id is scored, not learned from; repeated rows give
    repeated rows.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("raw"))
    model = fit(own, labels, rows=rows, sample_blocks=sample_blocks)
    made = scores(own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "raw"), model)
    return made.withColumn("predicted", (F.col("score") >= least).cast("int"))
