"""N-gram Jaccard join by signature trees.

Documents are sets of distinct five-word shingles; two link when their Jaccard similarity reaches a
threshold.  The result names each document's class of linked documents, and every link between
different texts counts.

1. One pass over the texts gives each document its set size and set key.  Equal sets share the key, so
   from here on copies are one node.  The same pass counts shingles in a sketch of fixed size.
2. Two sets that link share ``1 + e`` of their rarest ``n - ceil(t n) + 1 + e`` shingles under *any* global
   order.  The order used is (sketch count, key): it is the same for all documents whatever the sketch's
   error, so the filter loses nothing, and widespread passages come last.  A shingle that over ``FEW``
   nodes have so, with sizes that allow a link, ties them to a pivot.  Where fewer have it, each of the
   few pairs counts it, and a pair is tied if it has counted ``1 + e``: a pair that links and falls short
   has another such shingle in a larger run and is tied there.  Classes of ties are the blocks.
3. Inside a block a signature tree over the sets' bitmaps (nodes hold the union of bitmaps and the size
   range) is traversed against itself.  A node pair is cut when its size ranges or its largest possible
   overlap rule out every link below it; surviving leaf pairs are compared exactly, unless both sides are
   connected already.
4. A block over ``chunk`` nodes, or of large sets, is compared inside chunks of bounded size first.  One node of each class so
   found stands for it in a comparison of the classes.  Mostly one class is left; only where there are
   several, their nodes are compared across classes, never inside one, as pairs of chunks.  A class that
   holds nearly all of a block thus costs time in proportion to its size.

Shingles on hot keys are salted by the sketch's count, so no task gathers a key of unbounded frequency.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.llm.components import components
from bitspark.llm.scratch import Stored, small
from bitspark.llm.textkit import U, chunks, distinct, mix, set_key, shingles, words

SLICE = 1 << 16
BITMAP_BITS = 8192
LEAF = 8
HOT = 1 << 14
FEW = 4
CHUNK_SET_BYTES = 1 << 25  # sets that one side of a comparison holds at most, but for a single larger set
SALT_SHIFT = 40  # a row's size carries its key's number of salts, less one, in the bits above


def _spare(n, num: int, den: int):
    """Shingles beyond the least prefix; grows with the size, and never asks for more common ones than a link has."""
    return np.minimum(-(-num * n // den) - 1, n // 16)


def _unsalt(grp: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Its own inverse: a key with its salt worked in, or the key again."""
    return grp ^ np.where(salt > 0, mix(salt * U(0xD6E8FEB86659FD93)), U(0))


def _need(total: np.ndarray | int, num: int, den: int):
    """Least overlap of two sets with ``total`` elements together: den * i >= num * (total - i)."""
    return -((-num * total) // (num + den))


# ---------------------------------------------------------------- pass 1: sizes, set keys, sketch


def _measure(width: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << bits, np.uint32)
        waiting: list[np.ndarray] = []

        def flush() -> None:
            if waiting:
                sketch[:] += np.bincount(np.concatenate(waiting), minlength=1 << bits).astype(np.uint32)
                waiting.clear()

        for pdf in batches:
            ids, texts = pdf["doc_id"].array, pdf["text"].tolist()
            size, key = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for first, raw in chunks(texts):
                found = list(shingles(*words(raw), width))
                for i, s in enumerate(found, first):
                    size[i], key[i] = len(s), set_key(s)
                waiting.append((np.concatenate(found) & U((1 << bits) - 1)).astype(np.int64))
                if sum(map(len, waiting)) > 1 << 22:
                    flush()
            yield pd.DataFrame({"doc_id": ids, "n": size, "fp": key, "slice": pd.array([pd.NA] * len(texts), "Int32"), "counts": None})
        flush()
        for k in range(0, len(sketch), SLICE):
            part = sketch[k : k + SLICE]
            if part.any():
                yield pd.DataFrame({"doc_id": pd.array([pd.NA], "Int64"), "n": 0, "fp": 0, "slice": pd.array([k // SLICE], "Int32"), "counts": [_pack(part)]})

    return run


def _pack(counts: np.ndarray) -> bytes:
    """Counts as compressed planes of their bytes: nearly all are below 256."""
    return zstandard.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(len(counts), -1).T).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _merge_sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for k, blob in zip(pdf["slice"], pdf["counts"], strict=True):
            part = _unpack(blob, np.uint32).astype(np.uint64)
            total[k] = total[k] + part if k in total else part
    for k, part in total.items():
        ranks = np.minimum(255, np.floor(8 * np.log2(part + 1.0))).astype(np.uint8)
        yield pd.DataFrame({"slice": [k], "ranks": [zlib.compress(ranks.tobytes(), 1)]})


def _ranks(sketch: DataFrame, bits: int) -> np.ndarray:
    """The merged sketch as one byte a cell: eight times the logarithm of its count.  ``2**bits`` bytes on the driver."""
    slices = max(1, (1 << bits) // SLICE)
    out = np.zeros(1 << bits, np.uint8)
    merged = sketch.select("slice", "counts").repartition(min(slices, 64), "slice")
    for row in merged.mapInPandas(_merge_sketch, "slice int, ranks binary").collect():
        part = np.frombuffer(zlib.decompress(row["ranks"]), np.uint8)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return out


# ---------------------------------------------------------------- pass 2: rarest shingles, ties


def _rarest(width: int, bits: int, ranks, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.frombuffer(ranks.value, np.uint8)
        seen: set[int] = set()
        for pdf in batches:
            for _, raw in chunks(pdf["text"].tolist()):
                keys, nodes, sizes, counts = [], [], [], []
                for s in shingles(*words(raw), width):
                    n = len(s)
                    if not n or (fp := int(set_key(s))) in seen:
                        continue
                    if len(seen) < 1 << 18:  # copies in one task are sent once; beyond that they only cost rows
                        seen.add(fp)
                    r = rank[(s & U((1 << bits) - 1)).astype(np.int64)]
                    keep = n - -(-num * n // den) + 1 + int(_spare(n, num, den))
                    first = np.lexsort((s, r))[:keep]
                    keys.append(s[first])
                    counts.append(r[first])
                    nodes.append(np.full(len(first), fp))
                    sizes.append(np.full(len(first), n))
                if keys:
                    key, node, r = np.concatenate(keys), np.concatenate(nodes), np.concatenate(counts)
                    salts = np.maximum(1, np.ceil(2.0 ** (r / 8.0) / HOT)).astype(U)
                    grp = _unsalt(key, mix(node.astype(U)) % salts)
                    packed = np.concatenate(sizes) + ((salts.astype(np.int64) - 1) << SALT_SHIFT)
                    yield pd.DataFrame({"grp": grp.astype(np.int64), "n": packed, "fp": node})

    return run


def _tie(num: int, den: int):
    """Rows sorted by (grp, n, fp) -> ties ``a, b, need``.

    A run is the rows of a group up to a size that no longer allows a link with the row before.  Runs of
    over ``FEW`` nodes, and all of salted keys, give ties to their first node, with ``need`` 0; the others
    give their pairs, with the count that a pair needs.  A salted run also gives its first node as a row
    with ``need`` -1, the key as ``a`` and the node as ``b``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last run so far: all its rows while it has FEW or fewer, else its first and last
        large = False  # the held run has given ties already
        for pdf in _then_none(batches):
            rows = np.zeros((0, 3), np.int64) if pdf is None else pdf[["grp", "n", "fp"]].to_numpy(np.int64)
            if held is not None:
                rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            if large:  # the first row leads the run and its size may be far below the last one's
                lead, rows = rows[0], rows[1:]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(1)
            rows = rows[fresh]
            size, salts = rows[:, 1] & ((1 << SALT_SHIFT) - 1), (rows[:, 1] >> SALT_SHIFT) + 1
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (den * size[:-1] < num * size[1:])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(rows)))
            number = np.cumsum(new) - 1
            hot = salts[starts] > 1
            big = (lengths > FEW) | hot
            if large:
                big[0] = True
            first = rows[starts, 2]
            if large:
                first[0] = lead[2]
            open_ = len(starts) - 1 if pdf is not None else -1
            if open_ >= 0 and not big[open_]:
                done = number != open_
            else:
                done = np.ones(len(rows), bool)
            pivot = first[number]
            star = done & big[number] & (rows[:, 2] != pivot)
            out = [(rows[star, 2], pivot[star], np.zeros(star.sum(), np.int64))]
            small = np.flatnonzero(done & ~big[number])
            for step in range(1, FEW):
                other = small + step
                ok = other < len(rows)
                i, j = small[ok], other[ok]
                same = number[i] == number[j]
                i, j = i[same], j[same]
                out.append((rows[i, 2], rows[j, 2], 1 + _spare(np.minimum(size[i], size[j]), num, den)))
            leads = starts[hot & ~((np.arange(len(starts)) == 0) & large)]
            node = rows[leads, 2]
            key = _unsalt(rows[leads, 0].astype(U), mix(node.astype(U)) % salts[leads].astype(U)).astype(np.int64)
            out.append((key, node, np.full(len(leads), -1)))
            a, b, need = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"a": np.where(need < 0, a, np.minimum(a, b)), "b": np.where(need < 0, b, np.maximum(a, b)), "need": need})
            if pdf is not None:
                last = rows[number == open_]
                if big[open_]:
                    held = np.stack((lead if large and open_ == 0 else last[0], last[-1]))
                    large = True
                else:
                    held, large = last, False

    return run


def _then_none(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


# ---------------------------------------------------------------- pass 3: sets of tied nodes, trees


def _sets(width: int, bits: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).view(bool)
        sent: set[int] = set()
        for pdf in batches:
            for _, raw in chunks(pdf["text"].tolist()):
                rows = []
                for s in shingles(*words(raw), width):
                    if len(s) and want[int(mix(set_key(s).astype(U)[None])[0]) & ((1 << bits) - 1)]:
                        fp = int(set_key(s))
                        if fp not in sent:
                            if len(sent) < 1 << 18:
                                sent.add(fp)
                            rows.append((fp, s.tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["fp", "items"])

    return run


def _wanted(bits: int):
    """Set keys -> the cells that they set, slice by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = distinct((mix(pdf["fp"].to_numpy().astype(U)) & U((1 << bits) - 1)).astype(np.int64))
            at = np.flatnonzero(np.diff(cell // SLICE, prepend=-1))
            yield pd.DataFrame({"slice": cell[at] // SLICE, "cells": [(x % SLICE).astype(np.uint16).tobytes() for x in np.split(cell, at[1:])]})

    return run


def _merge_wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for k, cells in zip(pdf["slice"], pdf["cells"], strict=True):
            total.setdefault(k, np.zeros(SLICE, bool))[np.frombuffer(cells, np.uint16)] = True
    for k, flags in total.items():
        yield pd.DataFrame({"slice": [k], "flags": [zlib.compress(np.packbits(flags).tobytes(), 1)]})


def _filter(nodes: DataFrame, bits: int) -> bytes:
    """A bit for every cell that some node's key has: ``2**bits / 8`` bytes, merged on the executors."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    merged = nodes.select("fp").mapInPandas(_wanted(bits), "slice int, cells binary").repartition(min(1 << bits >> 16, 64), "slice")
    for row in merged.mapInPandas(_merge_wanted, "slice int, flags binary").collect():
        out[row["slice"] * (SLICE >> 3) : (row["slice"] + 1) * (SLICE >> 3)] = np.frombuffer(zlib.decompress(row["flags"]), np.uint8)
    return out.tobytes()


class SignatureTree:
    """Union bitmaps and size ranges over sets, leaves of ``LEAF`` sets, each level halving the one below."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        size = np.array([len(s) for s in sets], np.int64)
        bits = np.zeros((len(sets), BITMAP_BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (mix(s) & U(BITMAP_BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        slack = size - np.bitwise_count(packed).sum(1).astype(np.int64)
        # level: (bitmaps, least size, most size, slack); a slack is how many elements share a bit with another
        self.levels = [(packed, size, size, slack)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(lo), step)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
            step = 2

    def _fan(self, level: int) -> int:
        return LEAF if level == 1 else 2

    def pairs(self, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """For a set i, the later sets j that no bound rules out, smallest pairs of nodes first cut from the root down."""
        level = len(self.levels) - 1
        a, b = np.array([0]), np.array([0])
        while level > 0:
            fan, below = self._fan(level), len(self.levels[level - 1][1])
            grid = np.arange(fan)
            a = (a[:, None, None] * fan + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            b = (b[:, None, None] * fan + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
            ok = (a < below) & (b < below) & (a <= b)
            level -= 1
            a, b = self._cut(level, a[ok], b[ok], num, den)
        ok = a < b
        order = np.lexsort((b[ok], a[ok]))
        a, b = a[ok][order], b[ok][order]
        for block in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else []:
            yield int(a[block[0]]), b[block]

    def _cut(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int, step: int = 1 << 14):
        bits, lo, hi, slack = self.levels[level]
        keep = np.ones(len(a), bool)
        keep &= (den * hi[a] >= num * lo[b]) & (den * hi[b] >= num * lo[a])
        a, b = a[keep], b[keep]
        keep = np.ones(len(a), bool)
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64)
            keep[k : k + step] = common + np.minimum(slack[x], slack[y]) >= _need(lo[x] + lo[y], num, den)
        return a[keep], b[keep]


def linked_classes(sets: list[np.ndarray], num: int, den: int, seeds: np.ndarray | None = None, sides: np.ndarray | None = None) -> np.ndarray:
    """For each sorted distinct set the smallest index of its class of linked sets.

    Sets with equal ``seeds`` are known to be connected.  With two kinds of ``sides``, only pairs of sets
    on different sides are compared.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if seeds is not None:
        first: dict[int, int] = {}
        for i, seed in enumerate(seeds.tolist()):
            parent[i] = first.setdefault(seed, i)
    across = sides is not None and len(np.unique(sides)) > 1
    if len(sets) > 1:
        for i, others in SignatureTree(sets).pairs(num, den):
            for j in (others[sides[others] != sides[i]] if across else others).tolist():
                x, y = find(i), find(j)
                if x != y:
                    s, t = sets[i], sets[j]
                    at = np.searchsorted(t, s)
                    at[at == len(t)] = 0
                    if int((t[at] == s).sum()) >= _need(len(s) + len(t), num, den):
                        parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


def _links(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in pdf.groupby("task", sort=False):
            block = block.drop_duplicates("fp")
            # similar sets have a similar least element, so that sorting by it puts them under one node
            sets = [np.frombuffer(x, U) for x in block["items"]]
            order = np.argsort([mix(s).min() for s in sets], kind="stable")
            sets, fps = [sets[k] for k in order], block["fp"].to_numpy()[order]
            root = linked_classes(sets, num, den, block["seed"].to_numpy()[order], block["side"].to_numpy()[order])
            hit = root != np.arange(len(root))
            out.append(pd.DataFrame({"a": fps[hit], "b": fps[root[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def _compare(tasks: DataFrame, bins: int, num: int, den: int, name: str) -> Stored:
    """Links ``a, b`` among the nodes ``(task, side, seed, fp, items)`` of each task."""
    dealt = tasks.select("task", "side", "seed", "fp", "items").withColumn("bin", F.pmod(F.xxhash64("task"), F.lit(bins)))
    return Stored(dealt.groupBy("bin").applyInPandas(_links(num, den), "a bigint, b bigint"), name)


def _block_links(nodes: DataFrame, parts: int, chunk: int, num: int, den: int) -> DataFrame:
    """Links that connect all linked nodes of each block; ``nodes(fp, items, root, m, w)`` with the block's nodes ``m`` and bytes ``w``."""
    pieces = lambda m, w: F.greatest(F.ceil(F.col(m) / F.lit(chunk)), F.ceil(F.col(w) / F.lit(CHUNK_SET_BYTES))).cast("int")
    cut = lambda m, w, by: F.pmod(F.xxhash64(by), pieces(m, w)).cast("int")
    nodes = nodes.withColumn("b", F.length("items"))
    total = nodes.agg(F.count("*").alias("m"), F.coalesce(F.sum("b"), F.lit(0)).alias("w")).first()
    bins = max(parts, math.ceil(total["m"] / chunk), math.ceil(total["w"] / CHUNK_SET_BYTES))
    inner = nodes.withColumn("side", F.lit(0)).withColumn("seed", F.col("fp")).withColumn("task", F.concat_ws("|", "root", cut("m", "w", "fp")))
    links = _compare(inner, bins, num, den, "links").df
    large = nodes.where(pieces("m", "w") > 1)
    if not large.limit(1).count():
        return links

    def classed(found: DataFrame) -> DataFrame:
        """Nodes of large blocks with their class so far."""
        known = Stored(components(found).select(F.col("node").alias("fp"), F.col("root").alias("seed")), "known")
        return Stored(large.select("fp", "root", "b").distinct().join(known.df, "fp", "left").withColumn("seed", F.coalesce("seed", "fp")), "classed").df

    def paired(placed: DataFrame, keep) -> DataFrame:
        """``placed(fp, root, seed, side)`` -> a task for each pair of a block's sides that ``keep`` allows."""
        sides = Stored(placed.select("root", "side").distinct(), "sides").df
        other = sides.select("root", F.col("side").alias("side2"))
        pairs = sides.join(other, "root").where((F.col("side") <= F.col("side2")) & keep)
        both = pairs.select("root", F.explode(F.array_distinct(F.array("side", "side2"))).alias("side"), F.concat_ws("|", "root", "side", "side2").alias("task"))
        return placed.join(both, ["root", "side"]).join(large.select("fp", "items"), "fp")

    first = classed(links)
    reps = first.where("fp = seed")  # a class is named by one of its nodes
    sizes = Stored(reps.groupBy("root").agg(F.count("*").alias("k"), F.sum("b").alias("w")), "reps").df
    placed = reps.join(sizes, "root").withColumn("side", cut("k", "w", "fp").cast("string"))
    more = _compare(paired(placed, F.lit(True)), bins, num, den, "more").df
    links = links.union(more)
    now = classed(links)
    counts = Stored(now.groupBy("root", "seed").agg(F.count("*").alias("c"), F.sum("b").alias("cw")).withColumn("parts", pieces("c", "cw")), "counts").df
    few = lambda x: F.sum(F.when(F.col("parts") == 1, F.col(x)).otherwise(0))
    open_ = counts.groupBy("root").agg(F.count("*").alias("k"), F.max("c").alias("most"), few("c").alias("rest"), few("cw").alias("rest_w")).where("k > 1 and most > 1")
    open_ = Stored(open_.select("root", "rest", "rest_w"), "open").df
    if not open_.limit(1).count():
        return links
    big = F.concat_ws(":", F.lit("big"), "seed", cut("c", "cw", "fp"))
    small_ = F.concat_ws(":", F.lit("few"), cut("rest", "rest_w", "seed"))
    placed = now.join(open_, "root").join(counts, ["root", "seed"]).withColumn("side", F.when(F.col("parts") > 1, big).otherwise(small_))
    name = lambda c: F.substring_index(c, ":", 2)
    apart = ~(F.col("side").startswith("big") & (name(F.col("side")) == name(F.col("side2"))))
    last = _compare(paired(placed, apart), bins, num, den, "last").df
    return links.union(last)


# ---------------------------------------------------------------- the operator


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (3, 4), chunk: int = 1024, sketch_bits: int | None = None,
) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their ``width``-word shingles.

    Returns ``doc_id, n_shingles bigint, component_id``: the set's size and the smallest ``doc_id`` that is
    reachable by links, itself included.  ``threshold`` is a fraction (numerator, denominator) up to 1.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Null and blank texts have no shingles and
    are linked with nothing (their class is their own id); a text under ``width`` words is one shingle.
    Repeated rows give repeated rows; equal texts under different ids are one class.  A null id stays
    null and never names a class that has other ids.  Other columns are ignored, whatever their names.
    An empty table gives an empty result.  Ids must be integers.
    """
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("threshold must be a fraction in (0, 1]")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if sketch_bits is None:
        sketch_bits = min(24, max(16, math.ceil(math.log2(16 * docs.count() + 1))))
    texts = docs.select("text")

    measured = Stored(docs.mapInPandas(_measure(width, sketch_bits), "doc_id bigint, n bigint, fp bigint, slice int, counts binary"), "measured")
    rows = measured.df.where("slice is null").select("doc_id", "n", "fp")
    ranks = spark.sparkContext.broadcast(_ranks(measured.df.where("slice is not null"), sketch_bits).tobytes())

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rare = texts.where("text is not null").mapInPandas(_rarest(width, sketch_bits, ranks, num, den), "grp bigint, n bigint, fp bigint")
    ties = Stored(rare.repartition(parts, "grp").sortWithinPartitions("grp", "n", "fp").mapInPandas(_tie(num, den), "a bigint, b bigint, need bigint"), "ties")
    few = ties.df.where("need > 0").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    # the first nodes of the salted parts of one hot key meet at that of the least
    leads = ties.df.where("need = -1").select(F.col("a").alias("key"), "b").distinct()
    across = leads.join(leads.groupBy("key").agg(F.min("b").alias("a")), "key").select("a", "b")
    blocks = Stored(components(few.union(ties.df.where("need = 0").select("a", "b")).union(across)).select(F.col("node").alias("fp"), "root"), "blocks")
    ties.drop()

    # at most 2^28 bits, 32 MB; a fuller filter lets sets through that the join below leaves out
    cell = min(28, max(22, math.ceil(math.log2(8 * blocks.df.count() + 1))))
    wanted = spark.sparkContext.broadcast(_filter(blocks.df, cell))
    sized = blocks.df.join(rows.where("n > 0").groupBy("fp").agg(F.first("n").alias("n")), "fp")
    sizes = Stored(sized.groupBy("root").agg(F.count("*").alias("m"), (F.sum("n") * 8).alias("w")), "sizes")
    placed = Stored(blocks.df.join(sizes.df, "root").select("fp", "root", "m", "w"), "placed")
    sets = texts.where("text is not null").mapInPandas(_sets(width, cell, wanted), "fp bigint, items binary")
    nodes = Stored(sets.join(small(placed.df), "fp"), "sets")
    blocks.drop()
    sizes.drop()
    placed.drop()
    classes = components(_block_links(nodes.df, parts, chunk, num, den))
    nodes.drop()

    named = rows.where("n > 0")
    least = named.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    least = Stored(least.withColumn("root", F.coalesce("root", "fp")), "least")
    best = Stored(least.df.groupBy("root").agg(F.min("least").alias("component_id")), "best")
    final = Stored(least.df.join(best.df, "root").select("fp", "component_id"), "classes")
    least.drop()
    best.drop()
    out = named.join(final.df, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of each class of near-duplicates: that with the smallest id stays.

    Rows are told apart by themselves, not by their ids: different texts under one id are judged apart, of
    equal ids in a class that with the smallest hash of its columns stays, and a null id comes after all
    others.  Rows without words are in no class and stay.  Options are those of ``near_duplicates``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = Stored(docs.select(F.struct(*columns).alias("d"), F.monotonically_increasing_id().alias("r")), "rows", "zstd").df
    classes = near_duplicates(rows.select(F.col("r").alias("doc_id"), F.col(f"d.`{text}`").alias("text")), **options)
    named = rows.select("r", F.col(f"d.`{doc_id}`").cast("bigint").alias("i"), F.xxhash64("d").alias("h")).join(classes.select(F.col("doc_id").alias("r"), "component_id"), "r")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("z"), "i", "h", "r")).alias("m")).select("m.r")
    return _marked(rows, first).select("d.*")


#: Rows that one bitmap tells of; Spark's bitmaps have 4 KB.
BITMAP_ROWS = 1 << 15


def _marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``rows`` whose number ``r``, a partition and a place in it, is in ``chosen(r)``.

    A bit for each row, so that the rows stay where they are: up to 64 MB of bitmaps, for half a billion rows, are sent to
    all tasks; beyond, rows and bitmaps meet by their number.
    """
    low = F.col("r").bitwiseAND(F.lit((1 << 33) - 1))
    run, place = F.concat_ws("/", F.shiftright("r", 33), F.floor(low / BITMAP_ROWS)), (low % BITMAP_ROWS).cast("int")
    bitmaps = Stored(chosen.groupBy(run.alias("run")).agg(F.bitmap_construct_agg(place).alias("bits")), "kept").df
    byte = F.conv(F.hex(F.col("bits").substr((place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("run", run).join(small(bitmaps, 1 << 14), "run").where(F.bit_get(byte, place % 8) == 1)
