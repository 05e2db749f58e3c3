"""Training a layer, and stacking layers.

The driver holds the filters, and between two counting jobs the candidates; counts stay on the executors.  Rows are
distinct windows with weights, written once per layer to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.operators import kernels
from bitspark.operators.model import Model
from bitspark.operators.sequence import context_of, distinct_windows, file_windows
from bitspark.sources.shared import stored


@dataclass
class LayerReport:
    layer: int
    windows: int
    distinct: int
    correct: int
    accuracy: float
    sparsity: float
    n_set: list[int] = field(default_factory=list)
    bit_accuracy: list[float] = field(default_factory=list)


def fit_layer(
    rows: DataFrame, read: kernels.Reader, *, iterations: int = 4, n_candidates: int = 7, capacity_bits: int = 4, unit_thresholds: int = 2, exp_thresholds: int = 3, modulus_bits: int | None = 4, start: Model | None = None,
    ledger: Ledger | None = None, layer: int = 1,
) -> tuple[Model, list[np.ndarray]]:
    """Grow every output's filter: count single features, try all subsets of the best, keep the best subset and threshold.

    Returns the model and each iteration's accuracy counts by output.  Without rows there is nothing to
    count and a ValueError is raised.  With a ``ledger`` every iteration is written down, and those that are there already
    are taken from it.
    """
    model, history = start or Model.empty(), []
    if not rows.limit(1).count():
        raise ValueError("no windows to train on")
    for k in range(iterations):
        known = ledger.read(layer, k) if ledger else None
        if known is not None:
            model, accuracy = known
        else:
            unit = kernels.unit_table(rows, read, model, unit_thresholds, modulus_bits)
            cand_i, cand_s = kernels.search_candidates(unit, model, unit_thresholds, n_candidates)
            counts = kernels.exp_table(rows, read, model, cand_i, cand_s, exp_thresholds, modulus_bits)
            model, accuracy = kernels.search_update(counts, model, cand_i, cand_s, exp_thresholds, capacity_bits)
            if ledger:
                ledger.write(layer, k, model, accuracy)
        history.append(accuracy)
    return model, history


class Ledger:
    """Filters after every iteration of every layer, below a folder that outlives the application.

    An iteration counts once its folder is complete; what a lost run has left half written is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, layer: int, iteration: int) -> str:
        return f"{self.path}/layer={layer}/iteration={iteration}"

    def _done(self, layer: int, iteration: int) -> bool:
        sc = self.spark.sparkContext
        mark = sc._jvm.org.apache.hadoop.fs.Path(f"{self._at(layer, iteration)}/_SUCCESS")
        return mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark)

    def read(self, layer: int, iteration: int) -> tuple[Model, np.ndarray] | None:
        if not self._done(layer, iteration):
            return None
        rows = sorted(self.spark.read.parquet(self._at(layer, iteration)).collect(), key=lambda r: r["o"])
        return Model(np.stack([np.frombuffer(r["weight"], np.int8) for r in rows]).copy(), np.array([r["threshold"] for r in rows])), np.array([r["accuracy"] for r in rows])

    def write(self, layer: int, iteration: int, model: Model, accuracy: np.ndarray) -> None:
        rows = [(o, model.weight[o].tobytes(), int(model.threshold[o]), int(accuracy[o])) for o in range(len(accuracy))]
        made = self.spark.createDataFrame(rows, "o int, weight binary, threshold bigint, accuracy bigint")
        made.coalesce(1).write.mode("overwrite").parquet(self._at(layer, iteration))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly: a stored table may be a single small file, but each row costs the same work."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def by_context(rows: DataFrame, width: int) -> DataFrame:
    """Windows dealt evenly, those of one context to one task and next to each other."""
    spark = rows.sparkSession
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(count, context_of("code", width)).sortWithinPartitions("code")


def train_stack(docs: DataFrame, *, layers: int = 5, column: str = "text", unlabelled: bool = True, ledger: str | None = None, **options) -> tuple[list[Model], list[LayerReport]]:
    """Train layers on the bytes of ``column``; each layer's outputs are the next one's inputs.

    Windows don't cross rows.  The accuracy's denominator includes, like the files' version, windows
    without a following byte if ``unlabelled``.  A run that ended early goes on from the iterations that are below the
    folder ``ledger``, if the data and the options are the same.
    """
    models, reports = [], []
    options["ledger"] = Ledger(docs.sparkSession, ledger) if ledger else None
    for k in range(1, layers + 1):
        rows = stored(by_context(distinct_windows(docs, k + 2, column), k + 2), f"windows{k}")
        size = F.octet_length(F.encode(column, "UTF-8")) if dict(docs.dtypes)[column] == "string" else F.octet_length(column)
        every = docs.agg(F.coalesce(F.sum(F.greatest(size - k, F.lit(0))), F.lit(0)).alias("n")).first()["n"] if unlabelled else None
        _one_layer(rows, models, reports, every, None, options)
    return models, reports


def train_file(spark: SparkSession, path: str, train_windows: int | None = None, *, layers: int = 5, ledger: str | None = None, **options) -> tuple[list[Model], list[LayerReport]]:
    """Train on one file as a stream, read in splits: filters are fitted to its first ``train_windows`` windows and measured on all.

    A file with fewer windows than that is an error.  ``ledger`` is as with ``train_stack``.
    """
    models, reports = [], []
    options["ledger"] = Ledger(spark, ledger) if ledger else None
    for k in range(1, layers + 1):
        rows = stored(by_context(file_windows(spark, path, k + 2), k + 2), f"windows{k}")
        head = None if train_windows is None else stored(by_context(file_windows(spark, path, k + 2, train_windows), k + 2), f"head{k}")
        if head is not None and head.agg(F.sum("n")).first()[0] != train_windows:
            raise ValueError(f"the file has fewer than {train_windows} windows for layer {k}")
        labelled = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        _one_layer(rows, models, reports, labelled + 1, head, options)
    return models, reports


def _one_layer(rows: DataFrame, models: list[Model], reports: list[LayerReport], every: int | None, head: DataFrame | None, options: dict) -> None:
    read = kernels.window_reader(list(models))
    model, history = fit_layer(head if head is not None else rows, read, layer=len(models) + 1, **options)
    got = kernels.score(rows, read, model).first()
    trained = head.agg(F.sum("n")).first()[0] if head is not None else got["rows"]
    total = every if every is not None else got["rows"]
    reports.append(LayerReport(
        len(models) + 1, got["rows"], rows.count(), got["correct"], got["correct"] / total if total else 0.0, model.sparsity, [int(model.n_set.sum())], [float(h.mean() / trained) for h in history],
    ))
    models.append(model)


def report_table(spark: SparkSession, reports: list[LayerReport]) -> DataFrame:
    return spark.createDataFrame(
        [(r.layer, r.windows, r.distinct, r.correct, r.accuracy, r.sparsity, r.bit_accuracy) for r in reports],
        "layer int, windows bigint, distinct_windows bigint, correct bigint, accuracy double, sparsity double, bit_accuracy array<double>",
    )
