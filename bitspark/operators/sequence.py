"""Byte sequences and their windows.

A window of layer k is k + 1 bytes of context and the byte after them.  Windows are functions of their
bytes alone, so equal windows collapse into one weighted row, and everything later works on those rows.
A window of up to seven bytes is packed into one integer, first byte highest; a wider one is kept as its bytes.

A stream is a sequence of rows: the text of a table in some order, or a file that Spark reads in splits.  Each
partition counts the windows inside its own run of bytes; of a run only the first and last bytes, fewer than a
window has, go to where the runs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.sources.shared import stored

MOST_BYTES = 7
HELD = 1_000_000  # windows that a task gathers before it puts equal ones together; half as many where one takes two words
FRAME = 1 << 16  # rows that leave a task at once
PART_BYTES = 1 << 21  # of wide windows, text whose windows one partition adds up
BLOCKS = 4  # of HELD windows, whose runs are put together before they leave a task
RUN = 64  # wide windows that travel as one run of bytes at most
RUNS = "stream string, place bigint, size bigint, head binary, tail binary, code {code}, n bigint"


def utf8_bytes(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pos int, byte int``: every byte of every text, in order.  Null texts have none."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return rows.select(doc_id, F.posexplode(pairs).alias("pos", "h")).select(doc_id, "pos", F.conv("h", 16, 10).cast("int").alias("byte"))


def windows(data: DataFrame, width: int, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, pos, b0 .. b{width-1}`` for every run of ``width`` bytes inside a document, from ``utf8_bytes`` rows."""
    from pyspark.sql import Window as W

    order = W.partitionBy(doc_id).orderBy("pos")
    out = data.select(doc_id, "pos", F.col("byte").alias("b0"), *[F.lead("byte", k).over(order).alias(f"b{k}") for k in range(1, width)])
    return out.where(F.col(f"b{width - 1}").isNotNull()) if width > 1 else out


def text_windows(rows: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``windows`` of texts of their own, made where each text lies: no byte moves, and repeated ids don't mix."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    each = rows.select(doc_id, F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int")).alias("bytes"))
    n = F.greatest(F.size("bytes") - (width - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice("bytes", k + 1, n).alias(f"b{k}") for k in range(width)])
    return each.select(doc_id, F.posexplode(beside).alias("pos", "w")).select(doc_id, "pos", "w.*")


def _windows_of(data: np.ndarray, width: int) -> np.ndarray:
    """Windows of a run of bytes: packed integers, or rows of eight bytes each where a window is too wide for one, filled up with zeros."""
    n = max(0, len(data) - width + 1)
    if width <= MOST_BYTES:
        code = data[:n].astype(np.int64)
        for k in range(1, width):
            code = (code << 8) | data[k : k + n]
        return code
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    if n:
        full[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)
    return full.view(">u8").astype(np.uint64)


def _run_lengths(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs; a plain sort where it can be, which is much faster than an indirect one."""
    if times is None and values.ndim == 1:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable") if values.ndim == 1 else np.lexsort(values.T[::-1])
        values, times = values[order], times[order] if times is not None else None
    change = values[1:] != values[:-1]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), change if values.ndim == 1 else change.any(1))))
    if times is None:
        return values[starts], np.diff(np.append(starts, len(values)))
    return values[starts], np.add.reduceat(times, starts) if len(starts) else times


def _joined(codes: np.ndarray, counts: np.ndarray, new: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct values as one; what both have is added up in place, so that only values not seen before need space."""
    if not len(codes):
        return new, times
    if codes.ndim == 2:
        return _run_lengths(np.concatenate((codes, new)), np.concatenate((counts, times)))
    at = np.searchsorted(codes, new)
    known = codes[np.minimum(at, len(codes) - 1)] == new
    counts[at[known]] += times[known]
    fresh = ~known
    at = at[fresh]
    return np.insert(codes, at, new[fresh]), np.insert(counts, at, times[fresh])


class _Windows:
    """A task's windows with their counts; equal ones are put together whenever many have gathered, so that memory follows distinct windows."""

    def __init__(self, width: int):
        self.width, self.waiting, self.held = width, [], 0
        self.most = max(1, HELD // (1 if width <= MOST_BYTES else -(-width // 8)))
        self.codes, self.counts = _windows_of(np.zeros(0, np.uint8), width), np.zeros(0, np.int64)

    def add(self, data: np.ndarray) -> Iterator[pd.DataFrame]:
        """Count a run of bytes; gives rows away when too many distinct ones are held."""
        for at in range(0, len(data) - self.width + 1, self.most):
            found = _windows_of(data[at : at + self.most + self.width - 1], self.width)
            self.waiting.append(found)
            self.held += len(found)
            if self.held >= self.most:
                self.merge()
                if len(self.codes) > 2 * self.most:
                    yield from self.rows()

    def merge(self) -> None:
        if self.waiting:
            new = np.concatenate(self.waiting)
            self.waiting, self.held = [], 0
            new, times = _run_lengths(new)
            self.codes, self.counts = _joined(self.codes, self.counts, new, times)

    def rows(self) -> Iterator[pd.DataFrame]:
        self.merge()
        for at in range(0, len(self.codes), FRAME):
            codes = self.codes[at : at + FRAME]
            if codes.ndim == 2:
                raw, size = codes.astype(">u8").tobytes(), 8 * codes.shape[1]
                codes = [raw[k : k + self.width] for k in range(0, len(raw), size)]
            yield pd.DataFrame({"code": codes, "n": self.counts[at : at + FRAME]})
        self.codes, self.counts = self.codes[:0].copy(), self.counts[:0].copy()  # a view would keep all of them


def _raw(value) -> np.ndarray:
    """The bytes of a text or binary value; null has none."""
    if value is None:
        return np.zeros(0, np.uint8)
    return np.frombuffer(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value), np.uint8)


def code_type(width: int) -> str:
    if width < 1:
        raise ValueError("a window has one byte or more")
    return "bigint" if width <= MOST_BYTES else "binary"


def context_of(code: Column | str, width: int) -> Column:
    """A window without its last byte."""
    code = F.col(code) if isinstance(code, str) else code
    return F.shiftright(code, 8) if width <= MOST_BYTES else F.substring(code, 1, width - 1)


def distinct_windows(rows: DataFrame, width: int, column: str = "text", by_context: bool = False) -> DataFrame:
    """``code, n bigint``: every distinct window of ``width`` bytes and how often it occurs.

    ``column`` holds texts or binary values; windows don't cross rows.  Each task adds up its own windows
    before the one shuffle, so what moves is distinct windows per task.  With ``by_context`` windows that differ in the
    last byte only are neighbours in one partition, as the kernels like them.  Windows too wide for an integer, which
    hardly collapse, move as runs of bytes.
    """
    if width > MOST_BYTES:
        return _wide_windows(rows, width, column, by_context)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Windows(width)
        for pdf in batches:
            for value in pdf[column]:
                yield from own.add(_raw(value))
        yield from own.rows()

    return _summed(rows.select(column).mapInPandas(run, f"code {code_type(width)}, n bigint"), width, by_context)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs_of(pieces: list[np.ndarray], width: int, cells: int) -> pa.Table:
    """``cell, run, n``: the windows of some pieces of text, each as long as a window or longer, as runs of bytes.

    A window's cell is that of the least hash of the few bytes at each place of its context, so that windows beside each
    other mostly share it; a run is windows in a row of one cell.
    """
    data, few = np.concatenate(pieces), min(MOST_BYTES, max(4, width - 5))
    n = len(data) - width + 1
    hashed = _mixed(_windows_of(data, few).astype(np.uint64))
    least = hashed[:n].copy()
    for k in range(1, width - few):
        np.minimum(least, hashed[k : k + n], out=least)
    good = np.ones(n, bool)  # no window lies in two pieces
    ends = np.cumsum([len(p) for p in pieces])[:-1]
    good[(ends[:, None] - np.arange(1, width)).ravel()] = False
    new = ~good
    new[0] = True
    new[1:] |= (least[1:] != least[:-1]) | ~good[:-1]
    start = np.flatnonzero(new)
    new |= (np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))) % RUN == 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n)) + width - 1
    start, size = start[good[start]], size[good[start]]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    raw = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    run = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    cell = pa.array((_mixed(least[start]) % np.uint64(cells)).astype(np.int32))
    return _together([pa.table({"cell": cell, "run": run, "n": np.ones(len(start), np.int64)})])


def _together(runs: list[pa.Table]) -> pa.Table:
    """Equal runs as one row, those of a cell together."""
    found = pa.concat_tables(runs).group_by(["cell", "run"], use_threads=False).aggregate([("n", "sum")])
    return found.select(["cell", "run", "n_sum"]).rename_columns(["cell", "run", "n"]).sort_by([("cell", "ascending"), ("run", "ascending")])


def _wide_windows(rows: DataFrame, width: int, column: str, by_context: bool) -> DataFrame:
    """``distinct_windows`` of windows that are bytes.

    Runs go to the partition of their cell, and there become windows and are counted.  There are as many partitions
    as the data ask for, so that what one of them counts is of one size, however long the table.
    """
    data = rows.select(F.col(column).cast("binary").alias("data"))
    total = data.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    cells = min(64 * parts, (1 << 31) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, made = [], 0, []
        for batch in batches:
            for value in batch.column(0):
                raw = np.frombuffer(value.as_py() or b"", np.uint8)
                for at in range(0, len(raw) - width + 1, HELD):
                    pieces.append(raw[at : at + HELD + width - 1])
                    held += len(pieces[-1])
                    if held >= HELD:
                        made.append(_runs_of(pieces, width, cells))
                        pieces, held = [], 0
                    if len(made) == BLOCKS:
                        yield from _together(made).to_batches(FRAME)
                        made = []
        if pieces:
            made.append(_runs_of(pieces, width, cells))
        if made:
            yield from _together(made).to_batches(FRAME)

    runs = data.mapInArrow(run, "cell int, run binary, n bigint").repartition(parts, "cell").groupBy("cell", "run").agg(F.sum("n").alias("n"))
    places = F.sequence(F.lit(1), F.octet_length("run") - (width - 1))
    each = runs.select("cell", "n", F.explode(F.transform(places, lambda k: F.substring("run", k, F.lit(width)))).alias("code"))
    found = each.groupBy("cell", "code").agg(F.sum("n").alias("n")).select("code", "n")  # where they are: a cell lies in one partition
    return found.sortWithinPartitions("code") if by_context else found


def _summed(part: DataFrame, width: int, by_context: bool) -> DataFrame:
    if not by_context or width == 1:
        return part.groupBy("code").agg(F.sum("n").alias("n"))
    near = part.withColumn("context", context_of("code", width)).repartition("context").groupBy("context", "code").agg(F.sum("n").alias("n"))
    return near.select("code", "n").sortWithinPartitions("code")


# ---------------------------------------------------------------- streams


def stream_windows(rows: DataFrame, width: int, by_context: bool = False) -> DataFrame:
    """``code, n`` of ``rows(stream string, place bigint, data binary, upto bigint)``: windows that cross rows too.

    The rows of a partition lie in the order of their stream; rows of one ``place`` lie together, and places are in the
    order of the stream over all partitions.  ``upto`` is null, or the number of bytes that count of the row's place.
    Of each place its first and last bytes meet those of the places beside it, so that what is put in order is a
    row for each place, however long the places are.
    """
    kind = code_type(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now, size = _Windows(width), None, 0
        head = tail = b""

        def ended() -> pd.DataFrame:
            return pd.DataFrame({"stream": [now[0]], "place": [now[1]], "size": [size], "head": [head], "tail": [tail], "code": [None], "n": [0]})

        for pdf in batches:
            for stream, place, data, upto in zip(pdf["stream"], pdf["place"], pdf["data"], pdf["upto"], strict=True):
                if now != (stream, place):
                    if now is not None:
                        yield ended()
                    now, size, head, tail = (stream, place), 0, b"", b""
                raw = bytes(data) if data is not None else b""
                if upto is not None and upto == upto:
                    raw = raw[: max(0, int(upto) - size)]
                size += len(raw)
                if len(head) < width - 1:
                    head += raw[: width - 1 - len(head)]
                raw = tail + raw  # what the place has so far ends in tail
                for made in own.add(np.frombuffer(raw, np.uint8)):
                    yield _as_runs(made)
                tail = raw[max(0, len(raw) - width + 1) :]
        if now is not None:
            yield ended()
        for made in own.rows():
            yield _as_runs(made)

    found = stored(rows.select("stream", "place", "data", "upto").mapInPandas(run, RUNS.format(code=kind)), "runs")

    def meet(places: pd.DataFrame) -> pd.DataFrame:
        own, out, tail = _Windows(width), [], b""
        for head, last in places.sort_values("place")[["head", "tail"]].itertuples(index=False):
            both = tail + bytes(head)
            if tail and head:  # each window in them crosses, as either is shorter than a window
                out += own.add(np.frombuffer(both, np.uint8))
            last = bytes(last)
            tail = last if len(last) == width - 1 else (tail + last)[-(width - 1) :] if width > 1 else b""
        return pd.concat([*out, *own.rows(), pd.DataFrame({"code": [], "n": []})]).astype({"n": "int64"})

    # a row for each place of a stream
    crossing = found.where("code is null").groupBy("stream").applyInPandas(meet, f"code {kind}, n bigint")
    return _summed(found.where("code is not null").select("code", "n").union(crossing), width, by_context)


def _as_runs(made: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"stream": None, "place": 0, "size": 0, "head": None, "tail": None, "code": made["code"], "n": made["n"]})


def table_stream(rows: DataFrame, order: list[Column | str], column: str = "text", partitions: int | None = None) -> DataFrame:
    """A table's values as one stream for ``stream_windows``: dealt to ranges of ``order`` and put in order inside each."""
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = rows.withColumn("data", F.col(column).cast("binary")).repartitionByRange(count, *order).sortWithinPartitions(*order)
    return data.select(F.lit("").alias("stream"), F.spark_partition_id().cast("bigint").alias("place"), "data", F.lit(None).cast("bigint").alias("upto"))


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files for ``stream_windows``, each a stream: Spark reads them in splits, by runs of bytes up to a line feed.

    A file may be larger than any row can hold; only a run without a line feed can't be beyond 2 GB.  A place is
    the split in which a run starts.  Bytes are taken as they are, whatever their encoding; files with the ending of a
    compression that Spark knows are read unpacked, and must end in a line feed.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("place"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))
    # the text source doesn't tell whether the last run ends in a line feed; the file's size does
    told = lines.groupBy("stream").agg(F.max("size").alias("size"), F.sum(F.octet_length("line") + 1).alias("sum"), F.max("place").alias("last"))
    short = {(r["stream"], r["last"]) for r in told.where("sum = size + 1").collect()}  # of files without a line feed at their end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, last = None, b""  # a split's last line may lack its line feed
        for pdf in batches:
            out, lines_of = [], []
            for stream, start, line in zip(pdf["stream"], pdf["place"], pdf["line"], strict=True):
                if place is not None:
                    lines_of.append(last + (b"\n" if place == (stream, start) or place not in short else b""))
                if place != (stream, start):
                    if lines_of:
                        out.append((*place, b"".join(lines_of)))
                    place, lines_of = (stream, start), []
                last = bytes(line)
            if lines_of:
                out.append((*place, b"".join(lines_of)))
            yield pd.DataFrame(out, columns=["stream", "place", "data"])
        if place is not None:
            yield pd.DataFrame([(*place, last + (b"" if place in short else b"\n"))], columns=["stream", "place", "data"])

    return lines.select("stream", "place", "line").mapInPandas(run, "stream string, place bigint, data binary").withColumn("upto", F.lit(None).cast("bigint"))


def unpacked(codes: pd.Series, width: int) -> np.ndarray:
    """``[row, byte]`` of packed windows: integers, or the bytes themselves of windows too wide for one."""
    if width <= MOST_BYTES:
        code = codes.to_numpy(np.int64)
        return np.stack([(code >> (8 * (width - 1 - k))) & 255 for k in range(width)], 1)
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, width).astype(np.int64)


def byte_of(code: Column | str, k: int, width: int) -> Column:
    """Byte ``k`` of a packed window."""
    code = F.col(code) if isinstance(code, str) else code
    if width > MOST_BYTES:
        return F.conv(F.hex(F.substring(code, k + 1, 1)), 16, 10).cast("int")
    return F.shiftright(code, 8 * (width - 1 - k)).bitwiseAND(F.lit(255)).cast("int")


def unpack(contexts: DataFrame, width: int) -> DataFrame:
    """``b0 .. b{width-1}, n`` from packed windows."""
    return contexts.select(*[byte_of("code", k, width).alias(f"b{k}") for k in range(width)], "n")


def first_bytes(places: DataFrame, upto: int) -> DataFrame:
    """Rows of a stream with what of their place lies in the stream's first ``upto`` bytes; places beyond are left out."""
    from pyspark.sql import Window as W

    sizes = stored(places.groupBy("stream", "place").agg(F.sum(F.octet_length("data")).alias("size")), "sizes")
    before = F.sum("size").over(W.partitionBy("stream").orderBy("place")) - F.col("size")
    left = sizes.select("stream", "place", (F.lit(upto) - before).alias("left")).where("left > 0")
    return places.drop("upto").join(F.broadcast(left), ["stream", "place"]).withColumnRenamed("left", "upto")


def file_windows(spark: SparkSession, path: str, width: int, first: int | None = None, by_context: bool = False) -> DataFrame:
    """Distinct windows of raw files, each one stream; ``first`` limits them to windows that start before that position."""
    data = file_stream(spark, path)
    return stream_windows(data if first is None else first_bytes(data, first + width - 1), width, by_context)
