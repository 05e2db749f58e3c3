"""The compression classifier: held-out accuracy, plain loops over the same dictionaries, and odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import zstandard

from bitspark.llm import compression

SYLLABLES = ["ba", "ko", "ri", "tu", "ne", "sha", "lor", "mi", "the", "an"]


def labelled(n, seed=0):
    """Plain prose is good; words said over and over, shouting and stray symbols are bad."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
    rows = []
    for k in range(n):
        w, good = [word() for _ in range(r.randint(20, 400))], int(r.random() < 0.75)
        if not good:
            kind = k % 3
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + r.choice(["$$$", "###", "&&&"]) for x in w] if kind == 1 else [x for x in w[:20] for _ in range(15)]
        rows.append((k, " ".join(w), good))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id bigint, text string, score string").repartition(5)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id bigint, quality int")
    return rows, docs, labels


def fold(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    truth = {d: q for d, _, q in rows}
    got = compression.classify(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 120 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean([truth[r.doc_id] for r in held])) < 0.05
    # calibrated: of texts with a middling score some are good and some aren't; sure ones are right
    assert np.mean([truth[r.doc_id] for r in held if r.score > 0.9]) > 0.97


def test_labels_of_held_out_ids_teach_nothing(spark, tables):
    rows, docs, labels = tables
    turned = spark.createDataFrame([(d, 1 - q if fold(d) else q) for d, _, q in rows], "doc_id bigint, quality int")
    assert compression.classify(docs, labels).orderBy("doc_id").collect() == compression.classify(docs.repartition(3), turned).orderBy("doc_id").collect()


def test_scores_equal_a_plain_loop(tables):
    rows, docs, labels = tables
    from pyspark.sql import functions as F

    own = docs.select("doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    model = compression.fit(own.select("doc_id", "raw"), labels, rows=50, sample_blocks=60)
    got = {r.doc_id: r.score for r in compression.scores(own, model).collect()}
    for d, text, _ in rows[:60]:
        sizes = []
        for raw in (model.bad, model.good, None):
            given = zstandard.ZstdCompressionDict(raw) if raw else None
            if given:
                given.precompute_compress(level=3)
            c = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text.encode()[k : k + 2048])) for k in range(0, len(text.encode()), 2048)))
        n, (bad, good, plain) = len(text.encode()), sizes
        m = sum(w * x for w, x in zip(model.weights, (1, (bad - good) / n, (bad - good) / plain, np.log(plain / n)), strict=True))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-9)


def test_samples_are_bounded(spark, tables, monkeypatch):
    _, docs, labels = tables
    seen = []
    made = compression.dictionary
    monkeypatch.setattr(compression, "dictionary", lambda samples, *a: seen.append(samples) or made(samples, *a))
    from pyspark.sql import functions as F

    compression.fit(docs.select("doc_id", F.col("text").cast("binary").alias("raw")), labels, rows=30, sample_blocks=25)
    assert max(map(len, seen)) <= 50 and all(len(b) <= compression.BLOCK_BYTES for s in seen for b in s)


def test_odd_tables(spark, docs, rows, empty, tables):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert compression.classify(empty, none).collect() == []
    got = compression.classify(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    good = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id bigint, quality int")
    assert {r.score for r in compression.classify(docs, good).collect()} == {1.0}
    # labels that differ, repeat, are null or of ids that repeat; very few blocks
    odd = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (None, 0), (4, None), (7, 0), (111, 1), (113, 0), (9, 5)], "doc_id bigint, quality int")
    got = compression.classify(docs, odd).collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 7}
    assert len(same) == 1
    big = spark.createDataFrame([(2**60 + 1, "x"), (None, "é" * 3_000_000)], "doc_id bigint, text string")
    assert {r.doc_id for r in compression.classify(big.unionByName(tables[1].select("doc_id", "text")), tables[2]).collect()} >= {2**60 + 1, None}


def test_calibration_of_separable_and_constant_features():
    x = np.stack((np.ones(40), np.arange(40) / 40, np.zeros(40)), axis=1)
    w = compression.calibrate(x, np.arange(40) >= 20)
    assert np.isfinite(w).all() and ((x @ w > 0) == (np.arange(40) >= 20)).all()
