"""Array kernels for whole layers: the same counts and predictions as the SQL operators, for all outputs at once.

Rows come either as packed windows, whose features are computed from the bytes and the layers before, or
as packed bit rows.  Windows of one context are put together, and what follows them becomes the weights of all target
bits by one transform.  A task adds up its own counts; one row for each output leaves it.  Counts stay where
they are added up: candidates and winning subsets are found there, and only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitspark.functions.codes import code_bits
from bitspark.operators import sliced
from bitspark.operators.model import Model
from bitspark.operators.sequence import unpacked
from bitspark.operators.transforms import nearest, ones_of, subset_ranks

BLOCK = 4096
CUBE_BYTES = 1 << 26  # counts that a task holds; a larger layer's outputs are counted a block at a time
RANKS = 1 << 19  # sums over subsets that are held at once, of as many outputs as that is


def matrix(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(D, k) with sums = X @ D + k: +1 for a plain weight, -1 and a constant 1 for a negated one."""
    return (model.weight == 0).astype(np.float32).T - (model.weight == 1).astype(np.float32).T, (model.weight == 1).sum(1).astype(np.float32)


class Bits:
    """Inputs of rows as 0 and 1."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __len__(self) -> int:
        return len(self.x)

    def sums(self, model: Model) -> np.ndarray:
        """Every filter's sum for every row."""
        d, k = matrix(model)
        return np.rint(self.x.astype(np.float32) @ d + k).astype(np.int64)

    def take(self, i: np.ndarray) -> np.ndarray:
        """The inputs ``i`` of every row."""
        return self.x[:, i]

    def weighted(self, d: np.ndarray) -> np.ndarray:
        """``[output, input]``: the sum of ``d[row, output]`` over the rows in which the input is 1."""
        kind = np.float32 if np.abs(d).sum(0).max(initial=0) < 1 << 24 else np.float64  # whole numbers that it holds
        return np.rint(d.astype(kind).T @ self.x.astype(kind)).astype(np.int64)


class Codes:
    """Inputs of a first layer, kept as the two bytes of which they are the codewords."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def sums(self, model: Model) -> np.ndarray:
        """A filter's sum over a codeword is one number for each byte."""
        d, k = matrix(model)
        table = [np.rint(code_bits().astype(np.float32) @ d[h * 256 : (h + 1) * 256]).astype(np.int64) for h in (0, 1)]
        return table[0][self.data[:, 0]] + table[1][self.data[:, 1]] + np.rint(k).astype(np.int64)

    def take(self, i: np.ndarray) -> np.ndarray:
        book = code_bits()
        return np.where(i < 256, book[self.data[:, 0]][:, i % 256], book[self.data[:, 1]][:, i % 256])

    def weighted(self, d: np.ndarray) -> np.ndarray:
        """A histogram of bytes for each output, and all 256 code bits of it by one transform."""
        halves = []
        for h in (0, 1):
            order = np.argsort(self.data[:, h], kind="stable")
            byte = self.data[order, h]
            start = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            histogram = np.zeros((256, d.shape[1]), np.int64)
            histogram[byte[start]] = np.add.reduceat(d[order], start, axis=0)
            halves.append(ones_of(histogram).T)
        return np.concatenate(halves, 1)


@dataclass
class Block:
    """Rows of equal inputs put together: how many there are, and of how many each target bit is 1; for bytes to foretell also how often each follows."""

    inputs: Bits | Codes
    n: np.ndarray
    ones: np.ndarray
    follows: np.ndarray | None = None


@dataclass
class Lanes:
    """Single rows turned into lanes of their columns, for counting on slices."""

    x: np.ndarray
    y: np.ndarray
    n: int


Reader = Callable[[pd.DataFrame], Iterator[Block | Lanes]]


def sums(model: Model, x: np.ndarray) -> np.ndarray:
    return Bits(x).sums(model)


def predict(model: Model, x: np.ndarray | Bits | Codes) -> np.ndarray:
    """Output bits: whether the sum of the masked, signed inputs exceeds the threshold."""
    return ((Bits(x) if isinstance(x, np.ndarray) else x).sums(model) > model.threshold).astype(np.uint8)


def inputs_of(data: np.ndarray, models: list[Model]) -> Bits | Codes:
    """Inputs of the layer after ``models`` from context bytes (one row each, one byte more than there are models, and one)."""
    if not models:
        return Codes(data)
    parts = [predict(models[0], Codes(data[:, j : j + 2])) for j in range(data.shape[1] - 1)]
    for m in models[1:]:
        parts = [predict(m, np.concatenate((a, b), 1)) for a, b in zip(parts, parts[1:], strict=False)]
    return Bits(np.concatenate(parts, 1))


def features(data: np.ndarray, models: list[Model]) -> np.ndarray:
    """The same inputs as bits."""
    made = inputs_of(data, models)
    return made.x if isinstance(made, Bits) else np.concatenate([code_bits()[data[:, j]] for j in range(data.shape[1])], 1)


def window_reader(models: list[Model]) -> Reader:
    """Rows ``code, n`` of ``len(models) + 3`` bytes -> blocks of distinct contexts; rows in order of their code leave fewer of them."""
    width = len(models) + 3

    def read(pdf: pd.DataFrame) -> Iterator[Block]:
        for at in range(0, len(pdf), BLOCK):
            data = unpacked(pdf["code"].iloc[at : at + BLOCK], width)
            n = pdf["n"].to_numpy(np.int64)[at : at + BLOCK]
            new = np.ones(len(data), bool)
            new[1:] = (data[1:, :-1] != data[:-1, :-1]).any(1)
            context = np.cumsum(new) - 1
            follows = np.bincount(context * 256 + data[:, -1], n, int(new.sum()) * 256).astype(np.int64).reshape(-1, 256)
            yield Block(inputs_of(data[new, :-1], models), follows.sum(1), ones_of(follows.T).T, follows)

    return read


def row_reader() -> Reader:
    """Rows ``x array<bigint>, y array<bigint>`` -> blocks of single rows."""

    def bits(words) -> np.ndarray:
        return np.unpackbits(np.stack(words.to_numpy()).astype(">i8").view(np.uint8), axis=1)

    def read(pdf: pd.DataFrame) -> Iterator[Block]:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at : at + BLOCK]
            yield Block(Bits(bits(part["x"])), np.ones(len(part), np.int64), bits(part["y"]).astype(np.int64))

    return read


def lane_reader() -> Reader:
    """The same rows as lanes: counted on slices, without a product."""

    def words(column) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)

    def read(pdf: pd.DataFrame) -> Iterator[Lanes]:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at : at + BLOCK]
            yield Lanes(sliced.lanes_of(words(part["x"])), sliced.lanes_of(words(part["y"])), len(part))

    return read


def _wrap(v, bits: int | None):
    return v if bits is None else v & ((1 << bits) - 1)


def unit_block(b: Block, model: Model, n_thresholds: int, bits: int | None) -> np.ndarray:
    """Counts [output, input, sign, threshold] of a block.

    A feature changes a row's verdict only where one more makes the sum exceed the threshold (or, where sums wrap, no
    longer exceed it); those rows, weighted by what they win, are multiplied with the inputs, once for each threshold.
    """
    base = _wrap(b.inputs.sums(model), bits)
    raised = _wrap(base + 1, bits)
    zeros = b.n[:, None] - b.ones
    out = []
    for t in range(n_thresholds):
        limit = _wrap(model.threshold + t, bits)
        plain, more = base > limit, raised > limit
        gain = b.inputs.weighted((more.astype(np.int64) - plain) * (b.ones - zeros))
        at = [np.where(v, b.ones, zeros).sum(0)[:, None] for v in (plain, more)]
        out.append(np.stack((at[0] + gain, at[1] - gain), 2))
    return np.stack(out, 3)


def exp_cells(b: Block, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, bits: int | None) -> np.ndarray:
    """``[output, cell]``: what rows of each base sum and pattern of candidates win if the verdict is yes, and in a last cell those that are right if it is no."""
    outputs, e = cand_i.shape
    base, top = _wrap(b.inputs.sums(model), bits), _base_sums(model, bits)
    pattern = np.zeros(base.shape, np.int64)
    for k in range(e):
        pattern |= (b.inputs.take(cand_i[:, k]) ^ cand_s[:, k]).astype(np.int64) << k
    zeros = b.n[:, None] - b.ones
    cell = (np.arange(outputs) * top + base << e) | pattern
    out = np.empty((outputs, (top << e) + 1), np.int64)
    out[:, :-1] = np.rint(np.bincount(cell.ravel(), (b.ones - zeros).ravel(), outputs * top << e)).astype(np.int64).reshape(outputs, -1)
    out[:, -1] = zeros.sum(0)
    return out


def _base_sums(model: Model, bits: int | None) -> int:
    most = int(model.n_set.max(initial=0)) + 1
    return most if bits is None else min(most, 1 << bits)


def exp_of_cells(cells: np.ndarray, model: Model, e: int, n_thresholds: int, bits: int | None) -> np.ndarray:
    """Counts [output, mask, threshold]: how many candidates of a mask are set is summed for all masks by one transform of each base sum."""
    top = _base_sums(model, bits)
    reach = _wrap(np.arange(top)[:, None] + np.arange(e + 1)[None, :], bits)  # base sum, candidates that are set
    out = np.empty((len(cells), 1 << e, n_thresholds), np.int64)
    step = max(1, RANKS // (top * (e + 1) << e))
    for o in range(0, len(cells), step):
        ranks = subset_ranks(cells[o : o + step, :-1].reshape(-1, top, 1 << e))
        for t in range(n_thresholds):
            above = reach[None] > _wrap(model.threshold[o : o + step] + t, bits)[:, None, None]
            out[o : o + step, :, t] = cells[o : o + step, -1:] + (ranks * above[:, :, None, :]).sum((1, 3))
    return out


def exp_block(b: Block, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, n_thresholds: int, bits: int | None) -> np.ndarray:
    """Counts [output, mask, threshold] of a block."""
    return exp_of_cells(exp_cells(b, model, cand_i, cand_s, bits), model, cand_i.shape[1], n_thresholds, bits)


def _totals(read: Reader, block, finish, low: int, groups: int):
    """Add up ``block`` over a task's rows; of outputs from ``low`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for b in read(pdf):
                part = block(b)
                if total is None:
                    total = part
                else:
                    total += part
        if total is not None:
            total = finish(total)
            yield pd.DataFrame({"g": TaskContext.get().partitionId() % groups, "o": np.arange(low, low + len(total), dtype=np.int32), "counts": [t.tobytes() for t in total]})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition added by output where Arrow holds them, as they stream by: a cube is held, not the counts of many tasks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for o, counts in zip(batch.column("o").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(counts.as_buffer(), np.int64)
            if o in total:
                total[o] += part
            else:
                total[o] = part.copy()  # else the whole batch would stay
    for o, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([counts.tobytes()])], names=["o", "counts"])


def _table(rows: DataFrame, read: Reader, model: Model, make, cell_bytes: int) -> DataFrame:
    """``o, counts binary``: every output's counts over all tasks, added up by groups of tasks and then by output.

    ``make(model, at)`` gives the counting of a block of rows, and its end, for the outputs ``at``.  If all outputs'
    counts are more than a task should hold, outputs are dealt to blocks, each counted by tasks of its own.
    """
    groups, outputs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(model.weight)
    size = max(1, min(outputs, CUBE_BYTES // max(1, cell_bytes)))
    out = None
    for low in range(0, outputs, size):
        part = Model(model.weight[low : low + size], model.threshold[low : low + size])
        block, finish = make(part, slice(low, low + size))
        made = rows.mapInPandas(_totals(read, block, finish, low, groups), "g int, o int, counts binary").repartition("g").mapInArrow(_add, "o int, counts binary")
        out = made if out is None else out.union(made)
    return out.repartition("o").mapInArrow(_add, "o int, counts binary")


def unit_table(rows: DataFrame, read: Reader, model: Model, n_thresholds: int = 2, modulus_bits: int | None = None) -> DataFrame:
    """``o, counts binary``: unit counts [input, sign, threshold] of every output, as whole numbers of eight bytes; those of used inputs are 0."""
    inputs = model.weight.shape[1]

    def make(part: Model, at: slice):
        def block(b: Block | Lanes) -> np.ndarray:
            if isinstance(b, Lanes):
                return sliced.unit_counts(b.x, b.y[at], b.n, part, n_thresholds, modulus_bits)
            return unit_block(Block(b.inputs, b.n, b.ones[:, at]), part, n_thresholds, modulus_bits)

        def finish(total: np.ndarray) -> np.ndarray:
            total[part.weight >= 0] = 0
            return total

        return block, finish

    return _table(rows, read, model, make, inputs * 2 * n_thresholds * 8)


def exp_table(rows: DataFrame, read: Reader, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, n_thresholds: int = 3, modulus_bits: int | None = None) -> DataFrame:
    """``o, counts binary``: exp counts [mask, threshold] of every output."""
    e = cand_i.shape[1]

    def make(part: Model, at: slice):
        def block(b: Block | Lanes) -> np.ndarray:
            if isinstance(b, Lanes):
                return sliced.exp_counts(b.x, b.y[at], b.n, part, cand_i[at], cand_s[at], n_thresholds, modulus_bits)
            return exp_cells(Block(b.inputs, b.n, b.ones[:, at]), part, cand_i[at], cand_s[at], modulus_bits)

        return block, lambda total: total if total.ndim == 3 else exp_of_cells(total, part, e, n_thresholds, modulus_bits)

    return _table(rows, read, model, make, (_base_sums(model, modulus_bits) << e) * 8)


def count_rows(table: DataFrame, shape: tuple[int, ...], names: list[str]) -> DataFrame:
    """A table of counts as rows ``o, names..., count``, made where the counts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [a.ravel() for a in np.indices(shape, np.int32)]
        for batch in batches:
            for o, counts in zip(batch.column("o").to_pylist(), batch.column("counts"), strict=True):
                columns = [np.full(len(axes[0]), o, np.int32), *axes, np.frombuffer(counts.as_buffer(), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["o", *names, "count"])

    return table.mapInArrow(run, f"o int, {', '.join(f'{n} int' for n in names)}, count bigint")


def _cube(table: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """A table's counts on the driver, of a size that the layer's shape fixes."""
    out = np.zeros(shape, np.int64)
    for r in table.collect():
        out[r["o"]] = np.frombuffer(r["counts"], np.int64).reshape(shape[1:])
    return out


def unit_cube(rows: DataFrame, read: Reader, model: Model, n_thresholds: int = 2, modulus_bits: int | None = None) -> np.ndarray:
    """Unit counts [output, input, sign, threshold]."""
    return _cube(unit_table(rows, read, model, n_thresholds, modulus_bits), (*model.weight.shape, 2, n_thresholds))


def exp_cube(rows: DataFrame, read: Reader, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, n_thresholds: int = 3, modulus_bits: int | None = None) -> np.ndarray:
    """Exp counts [output, mask, threshold]."""
    return _cube(exp_table(rows, read, model, cand_i, cand_s, n_thresholds, modulus_bits), (len(model.weight), 1 << cand_i.shape[1], n_thresholds))


def search_candidates(table: DataFrame, model: Model, n_thresholds: int = 2, n_candidates: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``candidates`` found where an output's unit counts are; the driver gets the winners only."""
    inputs = model.weight.shape[1]
    if (model.n_set > inputs - n_candidates).any():
        raise ValueError(f"a filter has fewer than {n_candidates} unused features")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for o, counts in zip(pdf["o"], pdf["counts"], strict=True):
                i, s = candidates(Model(model.weight[o : o + 1], model.threshold[o : o + 1]), np.frombuffer(counts, np.int64).reshape(1, inputs, 2, n_thresholds), n_candidates)
                yield pd.DataFrame({"o": np.int32(o), "slot": np.arange(n_candidates, dtype=np.int32), "i": i[0].astype(np.int32), "s": s[0].astype(np.int32)})

    out = np.zeros((2, len(model.weight), n_candidates), np.int64)
    for r in table.mapInPandas(run, "o int, slot int, i int, s int").collect():
        out[:, r["o"], r["slot"]] = r["i"], r["s"]
    return out[0], out[1].astype(np.uint8)


def search_update(table: DataFrame, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, n_thresholds: int = 3, capacity_bits: int = 4) -> tuple[Model, np.ndarray]:
    """``update`` decided where an output's exp counts are; the driver gets each output's mask, threshold and accuracy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for o, counts in zip(pdf["o"], pdf["counts"], strict=True):
                one = Model(model.weight[o : o + 1], model.threshold[o : o + 1])
                new, accuracy = update(one, cand_i[o : o + 1], cand_s[o : o + 1], np.frombuffer(counts, np.int64).reshape(1, -1, n_thresholds), capacity_bits)
                yield pd.DataFrame({"o": [np.int32(o)], "weight": [new.weight.tobytes()], "threshold": [int(new.threshold[0])], "accuracy": [int(accuracy[0])]})

    made, accuracy = Model(model.weight.copy(), model.threshold.copy()), np.zeros(len(model.weight), np.int64)
    for r in table.mapInPandas(run, "o int, weight binary, threshold bigint, accuracy bigint").collect():
        made.weight[r["o"]] = np.frombuffer(r["weight"], np.int8)
        made.threshold[r["o"]], accuracy[r["o"]] = r["threshold"], r["accuracy"]
    return made, accuracy


def candidates(model: Model, unit: np.ndarray, n_candidates: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, signs) [output, slot] with the tie rules of ``search.exp_candidates``."""
    free = model.weight < 0
    if (free.sum(1) < n_candidates).any():
        raise ValueError(f"a filter has fewer than {n_candidates} unused features")
    best = unit.max(3)
    sign = (best[:, :, 1] >= best[:, :, 0]).astype(np.uint8)
    count = np.where(free, best.max(2), -1)
    order = np.argsort(-count, axis=1, kind="stable")[:, :n_candidates]
    return order, np.take_along_axis(sign, order, 1)


def update(model: Model, cand_i: np.ndarray, cand_s: np.ndarray, counts: np.ndarray, capacity_bits: int = 4) -> tuple[Model, np.ndarray]:
    """The model with each output's winning candidates, and its accuracies, with the tie rules of ``search.choose``."""
    weight, threshold = model.weight.copy(), model.threshold.copy()
    masks = np.arange(counts.shape[1])
    size = np.bitwise_count(masks).astype(np.int64)
    best = counts.max(2)
    first = counts.argmax(2)
    fits = size[None, :] + model.n_set[:, None] < 1 << capacity_bits
    accuracy = np.zeros(len(weight), np.int64)
    for o in range(len(weight)):
        m = max(masks[fits[o]], key=lambda k: (best[o, k], -size[k], k))
        accuracy[o] = best[o, m]
        threshold[o] += first[o, m]
        for slot in np.flatnonzero(m >> np.arange(cand_i.shape[1]) & 1):
            weight[o, cand_i[o, slot]] = cand_s[o, slot]
    return Model(weight, threshold), accuracy


def apply_rows(rows: DataFrame, model: Model, code: str = "x", out: str = "out") -> DataFrame:
    """``rows`` with ``out array<bigint>``: the layer's output bits for the bit rows in ``code``, on slices of a block of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK].copy()
                part[out] = list(sliced.apply(np.stack(part[code].to_numpy()).astype(np.int64).view(np.uint64), model).view(np.int64))
                yield part

    return rows.mapInPandas(run, T.StructType([*[f for f in rows.schema if f.name != out], T.StructField(out, T.ArrayType(T.LongType()))]))


def count_outputs(pairs: DataFrame, model: Model) -> DataFrame:
    """``bit, kinds, n``: for each output of a first layer the sums of both weights of ``pairs(code, kinds, n)``, packed pairs of bytes, that set it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(model.weight), 2), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                bits = predict(model, Codes(unpacked(part["code"], 2)))
                total += bits.T.astype(np.int64) @ part[["kinds", "n"]].to_numpy(np.int64)
        yield pd.DataFrame({"bit": np.arange(len(total), dtype=np.int32), "kinds": total[:, 0], "n": total[:, 1]})

    return pairs.mapInPandas(run, "bit int, kinds bigint, n bigint").groupBy("bit").agg(F.sum("kinds").alias("kinds"), F.sum("n").alias("n")).where("kinds > 0")


def decode_bits(bits: np.ndarray) -> np.ndarray:
    """Byte of the nearest codeword of each row of output bits, the smallest of several."""
    return nearest(bits)


def _score(read: Reader, model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right = rows = bits = 0
        for pdf in batches:
            for b in read(pdf):
                out = predict(model, b.inputs)
                right += int(np.take_along_axis(b.follows, decode_bits(out)[:, None], 1).sum())
                bits += int(np.where(out == 1, b.ones, b.n[:, None] - b.ones).sum())
                rows += int(b.n.sum())
        yield pd.DataFrame({"correct": [right], "bits": [bits], "rows": [rows]})

    return run


def score(rows: DataFrame, read: Reader, model: Model) -> DataFrame:
    """``correct, bits, rows``: windows whose decoded byte is right, target bits that are right, and all windows."""
    part = rows.mapInPandas(_score(read, model), "correct bigint, bits bigint, rows bigint")
    return part.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "bits", "rows")])
