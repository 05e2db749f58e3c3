"""Performance runs over synthetic rows, and their derived points."""

from __future__ import annotations

import hashlib
import platform
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.operators import kernels, sliced
from bitspark.operators.model import INPUTS, OUTPUTS, STEPS, Model
from bitspark.sources.bits import PERF, synthetic_rows
from bitspark.sources.shared import stored


# Fixed value: how performance records name a run, by lane width in words and bits of a sum.
NAME = "bitslice-BitArray64x{lane}_u{bits}"


def test_model() -> Model:
    """The fixed test filters as arrays; see ``model.test_filters``."""
    m = Model.empty()
    for o in range(OUTPUTS):
        for step, even in STEPS:
            m.weight[o, o * step % INPUTS] = int(even) if o % 2 == 0 else 1 - int(even)
    m.threshold[:] = 1
    return m


def trimmed(n: int, lane_words: int, chunk: int = 4096) -> tuple[int, int]:
    """(chunk, rows) that sliced counting with lanes of ``lane_words`` words would use of ``n`` rows: whole lanes, whole chunks."""
    size = chunk // lane_words * lane_words
    return size, n // size * size


def _hash(cube: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(cube.tobytes(), digest_size=8).digest(), "little")


def _apply(model: Model):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["y"].to_numpy()).astype(np.int64).view(np.uint64)
                yield pd.DataFrame({"ones": [int(np.bitwise_count(sliced.apply(np.concatenate((y[:-1], y[1:]), 1), model)).sum())]})

    return run


def run_tests(spark: SparkSession, exponent: int, lanes: tuple[int, ...] = (1,), precisions: tuple[int | None, ...] = (3, 4, 5)) -> DataFrame:
    """One performance record: the unit, exp and apply stages timed for every lane width and precision.

    Lane widths only decide how many of the ``2**exponent`` rows are used.  With a precision rows are counted on slices,
    without one by products.  The apply stage runs over pairs of neighbouring target rows.  Hashes of the counts let
    runs be compared with each other.
    """
    model, tests = test_model(), []
    for bits in precisions:
        for lane in lanes:
            chunk, n = trimmed(1 << exponent, lane)
            rows = stored(synthetic_rows(spark, n), "perf")
            read, began = kernels.row_reader() if bits is None else kernels.lane_reader(), time.perf_counter_ns()
            unit = kernels.unit_cube(rows, read, model, 2, bits)
            t1 = time.perf_counter_ns()
            cand = kernels.candidates(model, unit)
            t2 = time.perf_counter_ns()
            counts = kernels.exp_cube(rows, read, model, *cand, 3, bits)
            t3 = time.perf_counter_ns()
            rows.mapInPandas(_apply(model), "ones bigint").agg(F.sum("ones")).collect()
            t4 = time.perf_counter_ns()
            name = "popcount" if bits is None else NAME.format(lane=lane, bits=bits)
            tests.append((name, chunk, n, t1 - began, t3 - t2, t4 - t3, t4 - began, _hash(unit), _hash(counts)))
    cores = spark.sparkContext.defaultParallelism
    from decimal import Decimal

    tests = [(*t[:7], Decimal(t[7]), Decimal(t[8])) for t in tests]
    return spark.createDataFrame([(platform.machine(), platform.processor(), cores, cores, 0.0, 0.0, tests)], PERF)


def perf_points(records: DataFrame) -> DataFrame:
    """``precision, x, y``: lane width in words against nanoseconds per example of both counts; other algorithms are left out."""
    test = records.select(F.explode("tests").alias("t")).select("t.*")
    name = "^" + NAME.format(lane=r"(\d+)", bits=r"(\d+)") + "$"
    shown = test.where(F.col("algorithm").rlike(name)).select(
        F.regexp_extract("algorithm", name, 2).cast("int").alias("precision"), F.regexp_extract("algorithm", name, 1).cast("int").alias("x"), ((F.col("exp_nanos") + F.col("unit_nanos")) / F.col("n_examples")).alias("y"),
    )
    return shown.where("x between 0 and 32 and precision in (3, 4, 5)")


def render_svg(points: DataFrame, scale: float, width: int = 800, height: int = 500) -> str:
    """A scatter plot of ``perf_points``: word multiple 0 to 34, time 0 to ``scale``, a colour for each precision."""
    colours = {3: "red", 4: "green", 5: "blue"}
    px, py = (lambda x: 50 + x / 34 * (width - 70)), (lambda y: height - 40 - y / scale * (height - 60))
    dots = [f'<circle cx="{px(r["x"]):.1f}" cy="{py(r["y"]):.1f}" r="3" fill="{colours[r["precision"]]}"/>' for r in points.orderBy("precision", "x").collect()]
    key = [f'<text x="{width - 90}" y="{30 + 18 * k}" fill="{c}">{p} bits</text>' for k, (p, c) in enumerate(colours.items())]
    axes = f'<path d="M50 20V{height - 40}H{width - 20}" fill="none" stroke="black"/><text x="55" y="18">ns per example, up to {scale:g}</text><text x="{width // 2}" y="{height - 10}">lane width in words</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{axes}{"".join(dots)}{"".join(key)}</svg>'
