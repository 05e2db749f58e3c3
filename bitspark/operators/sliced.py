"""Counting on slices: a machine word holds one bit of 64 rows.

Rows of bits are turned into lanes, one for each column.  A filter's sum is P planes, the bits of a P-bit number
for every row, grown by carry-save steps, a lane at a time; comparators find the rows whose sum exceeds a
threshold, and a count is a popcount.  Sums and thresholds are modulo 2^P; with enough planes nothing wraps.
The same counts as ``kernels.unit_block`` and ``exp_block`` for rows that don't collapse.
"""

from __future__ import annotations

import numpy as np

from bitspark.operators.model import Model

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)
TILE = 4
_LOW = U(0x00FF00FF00FF00FF)
_SUM = U(0x0001000100010001)


def turned(blocks: np.ndarray) -> np.ndarray:
    """Blocks of 64 words, each a square of bits, mirrored: first row and most significant column first."""
    out, step, low = blocks.copy(), 32, U(0xFFFFFFFF)
    while step:
        pairs = out.reshape(len(out), 32 // step, 2, step)
        above, below = pairs[:, :, 0], pairs[:, :, 1]
        moved = (above ^ below >> U(step)) & low
        above ^= moved
        below ^= moved << U(step)
        step >>= 1
        low ^= low << U(step)
    return out


def lanes_of(words: np.ndarray) -> np.ndarray:
    """``[row, word]`` -> ``[column, lane word]``: rows beyond the last 64 are filled up with zeros."""
    n, width = words.shape
    blocks = -(-n // 64)
    full = np.zeros((blocks * 64, width), U)
    full[:n] = words
    square = full.reshape(blocks, 64, width).transpose(0, 2, 1).reshape(blocks * width, 64)
    return np.ascontiguousarray(turned(square).reshape(blocks, width * 64).T)


def rows_of(lanes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` rows that lanes hold, as words; the reverse of ``lanes_of``."""
    width, blocks = len(lanes) // 64, lanes.shape[1]
    square = np.ascontiguousarray(lanes.T).reshape(blocks * width, 64)
    return turned(square).reshape(blocks, width, 64).transpose(0, 2, 1).reshape(blocks * 64, width)[:n]


def filled(n: int) -> np.ndarray:
    """Lane words in which the first ``n`` rows are there."""
    out = np.full(-(-n // 64), ALL)
    if n % 64:
        out[-1] = ALL << U(64 - n % 64)
    return out


def planes_for(model: Model, more: int, bits: int | None) -> int:
    """Planes that sums with ``more`` further terms need; ``bits`` where sums wrap."""
    return bits if bits is not None else int(model.n_set.max(initial=0) + more).bit_length()


def grow(planes: np.ndarray, carry: np.ndarray) -> None:
    """Add a bit for every row, in place; what the last plane carries is lost."""
    for plane in planes:
        out = plane & carry
        plane ^= carry
        carry = out


def base_planes(lanes: np.ndarray, model: Model, n_planes: int) -> np.ndarray:
    """``[plane, output, word]``: every filter's sum, one term of all filters at a time."""
    outputs = len(model.weight)
    planes = np.zeros((n_planes, outputs, lanes.shape[1]), U)
    order = np.argsort(model.weight < 0, axis=1, kind="stable")  # a filter's terms first
    for k in range(int(model.n_set.max(initial=0))):
        at = order[:, k]
        sign = model.weight[np.arange(outputs), at]
        flip = np.where(sign == 1, ALL, U(0))[:, None]
        used = np.where(sign >= 0, ALL, U(0))[:, None]
        grow(planes, (lanes[at] ^ flip) & used)
    return planes


def above(planes: np.ndarray, limit: np.ndarray, bits: int | None) -> np.ndarray:
    """``[output, word]``: rows whose sum is greater than the output's limit."""
    limit = limit & (1 << bits) - 1 if bits is not None else limit
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ALL)
    for p in reversed(range(len(planes))):
        has = np.where(limit >> p & 1, ALL, U(0))[:, None]
        more |= same & planes[p] & ~has
        same &= ~(planes[p] ^ has)
    more[limit >= 1 << len(planes)] = 0  # no sum is that large
    return more


def popcount(lanes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(lanes).sum(-1, dtype=np.int64)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``[i, j]``: rows in which both lane ``a[i]`` and lane ``b[j]`` are set."""
    words = a.shape[1]
    pad = -words % 8
    if pad:
        a, b = (np.pad(x, ((0, 0), (0, pad))) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, words, 1 << 12):  # sums of bytes fit 16 bits
        left, right = a[:, low : low + (1 << 12)], np.ascontiguousarray(b[:, low : low + (1 << 12)])
        both = np.empty((TILE, *right.shape), U)
        count = np.empty(both.shape, np.uint8)
        for k in range(0, len(a), TILE):
            m = min(TILE, len(a) - k)
            np.bitwise_count(np.bitwise_and(left[k : k + m, None], right[None], out=both[:m]), out=count[:m])
            eight = count[:m].view(U)
            sums = ((eight & _LOW) + (eight >> U(8) & _LOW)).sum(2)
            out[k : k + m] += ((sums & U(0xFFFF)) + (sums >> U(16) & U(0xFFFF)) + (sums >> U(32) & U(0xFFFF)) + (sums >> U(48))).astype(np.int64)
    return out


def unit_counts(x: np.ndarray, y: np.ndarray, n: int, model: Model, n_thresholds: int = 2, bits: int | None = None) -> np.ndarray:
    """Counts [output, input, sign, threshold] of ``n`` rows in lanes ``x`` and ``y``.

    A feature only matters to rows whose verdict one more changes: those lanes, with the target for and against, meet every feature's.
    """
    there = filled(n)
    base = base_planes(x, model, planes_for(model, 1, bits))
    more = base.copy()
    grow(more, np.full_like(base[0], ALL))
    out = np.zeros((len(y), len(x), 2, n_thresholds), np.int64)
    for t in range(n_thresholds):
        plain, raised = above(base, model.threshold + t, bits), above(more, model.threshold + t, bits)
        right = ~(raised ^ y) & there
        turns = (plain ^ raised) & there
        gain = common(turns & right, x) - common(turns & ~right, x)
        out[:, :, 0, t] = popcount(~(plain ^ y) & there)[:, None] + gain
        out[:, :, 1, t] = popcount(right)[:, None] - gain
    return out


def exp_counts(x: np.ndarray, y: np.ndarray, n: int, model: Model, cand_i: np.ndarray, cand_s: np.ndarray, n_thresholds: int = 3, bits: int | None = None) -> np.ndarray:
    """Counts [output, mask, threshold]: the tree of subsets is walked once, a candidate's lane added on the way down."""
    e, there = cand_i.shape[1], filled(n)
    out = np.zeros((len(y), 1 << e, n_thresholds), np.int64)
    lanes = [x[cand_i[:, k]] ^ np.where(cand_s[:, k] == 1, ALL, U(0))[:, None] for k in range(e)]

    def visit(k: int, mask: int, planes: np.ndarray) -> None:
        if k == e:
            for t in range(n_thresholds):
                out[:, mask, t] = popcount(~(above(planes, model.threshold + t, bits) ^ y) & there)
            return
        visit(k + 1, mask, planes)
        planes = planes.copy()
        grow(planes, lanes[k])
        visit(k + 1, mask | 1 << k, planes)

    visit(0, 0, base_planes(x, model, planes_for(model, e, bits)))
    return out


def apply(words: np.ndarray, model: Model) -> np.ndarray:
    """``[row, word]`` -> output words of every row: the layer's filters on lanes."""
    lanes = lanes_of(words)
    return rows_of(above(base_planes(lanes, model, max(1, planes_for(model, 0, None))), model.threshold, None), len(words))
