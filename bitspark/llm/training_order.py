"""Training-order materialisation.

Sequences are numbered, a keyed Feistel permutation gives each number its global slot, and every
``shard_slots`` consecutive slots are one file of fixed-length records in slot order.  A reader that has
consumed k sequences finds the next at record ``k % shard_slots`` of shard ``k // shard_slots``, by one
seek, and reads on sequentially.  Stride and shard size stand beside the shards.  Shards are as many as lets
tasks share the work, up to ``SHARD_BYTES`` each, so that their number stays small where there is much.

The permutation works on the least even number of bits that holds all numbers; an image outside the
range is permuted again until it falls inside (cycle-walking), which keeps it one-to-one.

A record: document id (8 bytes), part of the document (4), tokens in the record (4), all big-endian, then
``stride`` token ids of one byte each (the byte-level vocabulary: a text's UTF-8 bytes), zeros after the
last, and one line feed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.llm.scratch import store
from bitspark.llm.textkit import U, mix

HEADER = ">qii"
HEADER_SIZE = struct.calcsize(HEADER)
NO_ID = -(1 << 63)
ROUNDS = 6
TASK_BYTES = 1 << 30  # records that one task sorts and writes, if shards are larger in number than shuffle partitions
SHARD_BYTES = 1 << 29
LEAST_SLOTS = 1 << 14
LAYOUT = "sequences bigint, stride int, shard_slots bigint"
SEQUENCE = "slot bigint, doc_id bigint, part int, tokens binary"


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``x`` (values in [0, n)) under the permutation of [0, n) chosen by ``key``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << U(half)) | right

    out = once(np.asarray(x).astype(U))
    while (outside := out >= U(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _records(bases, n: int, key: int, stride: int, shard_slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = int(bases.value[TaskContext.get().partitionId()])
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at : at + 2048]
                out: list[bytes] = []
                for doc, raw in zip(pdf["doc_id"], pdf["raw"], strict=True):
                    doc = NO_ID if doc is None or doc != doc else int(doc)
                    for part in range(max(1, -(-len(raw) // stride))):
                        piece = raw[part * stride : (part + 1) * stride]
                        out.append(struct.pack(HEADER, doc, part, len(piece)) + piece.ljust(stride, b"\0"))
                slots = feistel(np.arange(number, number + len(out)), n, key) if out else np.zeros(0, np.int64)
                number += len(out)
                order = np.argsort(slots, kind="stable")
                shards = slots[order] // shard_slots
                cuts = np.flatnonzero(np.diff(shards)) + 1
                rows = [(int(shards[r[0]]), slots[order[r]].tobytes(), zstandard.compress(b"".join(out[k] for k in order[r]), 3)) for r in np.split(np.arange(len(order)), cuts) if len(r)]
                yield pd.DataFrame(rows, columns=["shard", "slots", "records"])

    return run


def _unpacked(stride: int):
    """Packets -> a row for each record."""
    size = HEADER_SIZE + stride

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, slots, records in zip(pdf["shard"], pdf["slots"], pdf["records"], strict=True):
                at, data = np.frombuffer(slots, np.int64), zstandard.decompress(records)
                yield pd.DataFrame({"shard": np.full(len(at), shard), "slot": at, "record": [data[k * size : (k + 1) * size] for k in range(len(at))]})

    return run


def _replayable(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain scan of files, which gives the same rows in the same partitions every time."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-*").split(" ")[0] for line in plan.splitlines() if line.strip()]
    return all(n in ("Project", "Filter") or n.startswith("Relation") for n in nodes)


def materialise(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", key: int = 1, stride: int = 512, shard_slots: int | None = None) -> int:
    """Write every document's sequences in training order below ``path``; returns their number.

    ``shard_slots`` is by default the power of two, from ``LEAST_SLOTS`` to what ``SHARD_BYTES`` hold, that makes about a
    thousand shards.

    A text of b bytes is ``max(1, ceil(b / stride))`` sequences; a null text is one empty sequence, and a
    null id is the least 64-bit integer.  Repeated rows are sequences of their own.  Other columns are
    ignored, whatever their names; an empty table writes nothing.

    Records travel in compressed packets, one for each shard that a batch reaches, and meet in ranges of
    slots: a task writes consecutive shards, one after the other.  Numbers are counted in each partition
    from that partition's base, with the same splits of the files in both jobs; a table that isn't a plain scan
    of files could deal its rows differently the second time, and is written to the shared folder first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("raw"))
    if not _replayable(rows):
        rows = store(rows, "sequences")
    with _fixed_splits(spark):
        parts = rows.rdd.getNumPartitions()
        sizes = rows.select(F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / stride)).alias("k"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.sum("k").alias("k"))
        counts = np.zeros(parts + 1, np.int64)  # eight bytes for each partition
        for r in sizes.collect():
            counts[r["p"] + 1] = r["k"]
        bases = np.cumsum(counts)
        n = int(bases[-1])
        if not n:
            return 0
        if shard_slots is None:
            most = 1 << (SHARD_BYTES // (HEADER_SIZE + stride + 1)).bit_length() - 1
            shard_slots = max(LEAST_SLOTS, min(most, 1 << (n // 1000).bit_length()))
        shards = -(-n // shard_slots)
        tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (HEADER_SIZE + stride + 1) // TASK_BYTES)))
        run = -(-shards // tasks)  # consecutive shards of one task, a range of slots
        made = rows.mapInPandas(_records(spark.sparkContext.broadcast(bases), n, key, stride, shard_slots), "shard bigint, slots binary, records binary")
        dealt = made.repartitionById(tasks, F.expr(f"cast(shard div {run} as int)"))
        ordered = dealt.mapInPandas(_unpacked(stride), "shard bigint, slot bigint, record binary").sortWithinPartitions("shard", "slot")
        ordered.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    _verify(spark, path, n, stride, shard_slots)
    spark.createDataFrame([(n, stride, shard_slots)], LAYOUT).coalesce(1).write.json(f"{path}/_layout")
    return n


@contextmanager
def _fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike in all jobs inside, though executors, and with them the default parallelism, come and go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _verify(spark: SparkSession, path: str, n: int, stride: int, shard_slots: int) -> None:
    """Raise unless every shard is one file of the length that its slots need; only names and lengths are read."""
    size = HEADER_SIZE + stride + 1
    files = spark.read.format("binaryFile").load(path).select("shard", "length")
    want = F.least(F.lit(shard_slots), F.lit(n) - F.col("shard") * shard_slots) * size
    seen = files.agg(F.count("*").alias("files"), F.count_if(F.col("length") == want).alias("whole")).first()
    if seen["files"] != seen["whole"] or seen["files"] != -(-n // shard_slots):
        raise RuntimeError(f"shards below {path} are incomplete: the documents changed while they were read")


def _read(stride: int, shard_slots: int, first: int, last: int):
    size = HEADER_SIZE + stride + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, data in zip(pdf["shard"], pdf["content"], strict=True):
                if len(data) % size:
                    raise ValueError(f"shard {shard} holds a broken record")
                base = int(shard) * shard_slots
                slots = range(max(base, first), min(base + len(data) // size, last))
                at = [(s - base) * size for s in slots]
                heads = [struct.unpack_from(HEADER, data, a) for a in at]
                yield pd.DataFrame({
                    "slot": list(slots), "doc_id": pd.array([None if h[0] == NO_ID else h[0] for h in heads], "Int64"), "part": [h[1] for h in heads],
                    "tokens": [data[a + HEADER_SIZE : a + HEADER_SIZE + h[2]] for a, h in zip(at, heads, strict=True)],
                })

    return run


def read_sequences(spark: SparkSession, path: str, *, first: int = 0, last: int | None = None) -> DataFrame:
    """``slot, doc_id, part, tokens`` of the slots in [first, last), from the shards that hold them only; none if nothing was written."""
    last = (1 << 62) if last is None else last
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # no documents, no shards
        return spark.createDataFrame([], SEQUENCE)
    layout = spark.read.schema(LAYOUT).json(f"{path}/_layout").first()
    stride, shard_slots = layout["stride"], layout["shard_slots"]
    files = files.where((F.col("shard") >= first // shard_slots) & (F.col("shard") * shard_slots < last))
    return files.select(F.col("shard").cast("bigint").alias("shard"), "content").mapInPandas(_read(stride, shard_slots, first, last), SEQUENCE)
