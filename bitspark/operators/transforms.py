"""Fast transforms behind the counts of whole layers.

Code bits are characters of the group of bytes: bit ``y`` of a byte's codeword says whether the byte and ``y`` share
an odd number of bits.  So the weights of all bytes whose code bit is set, for all 256 bits at once, are one
Walsh-Hadamard transform of a histogram of bytes, and the nearest codeword is where the transform of a row of signs
is greatest.  Sums over all subsets of candidates are a transform over the lattice of subsets.
"""

from __future__ import annotations

import numpy as np

from bitspark.functions.codes import code_index

#: Place of code bit ``y`` among the most-significant-first indices, and the other way round.
ORDER = code_index(np.arange(256))


def walsh(a: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the first axis, whose length is a power of two: sums of ``a[b]``, negated where ``b & y`` has an odd number of bits."""
    n, step = len(a), 1
    now = np.array(a, order="C").reshape(n, -1)
    then, m = np.empty_like(now), now.shape[1]
    while step < n:
        v, w = (x.reshape(n // (2 * step), 2, step * m) for x in (now, then))
        np.add(v[:, 0], v[:, 1], out=w[:, 0])
        np.subtract(v[:, 0], v[:, 1], out=w[:, 1])
        now, then, step = then, now, 2 * step
    return now.reshape(a.shape)


def ones_of(histogram: np.ndarray) -> np.ndarray:
    """``[byte, ...]`` weights -> ``[i, ...]``: the weight of the bytes whose code bit ``i`` (most significant first) is 1."""
    return ((histogram.sum(0) - walsh(histogram)) >> 1)[ORDER]


def nearest(bits: np.ndarray, run: int = 1024) -> np.ndarray:
    """Byte of the nearest codeword of each row of 256 bits, the smallest of several."""
    out = np.empty(len(bits), np.int64)
    for at in range(0, len(bits), run):
        part = bits[at : at + run]
        signs = np.empty((256, len(part)), np.int16)
        signs[:] = part.T[ORDER]
        out[at : at + run] = walsh(1 - 2 * signs).T.argmax(1)
    return out


def subset_ranks(a: np.ndarray) -> np.ndarray:
    """``[..., pattern]`` -> ``[..., mask, k]``: the sum over patterns that have ``k`` bits inside the mask.

    A bit at a time: with the bit outside of the mask both halves add up, with it inside the set half moves up by one.
    """
    n = a.shape[-1]
    e = n.bit_length() - 1
    out = np.zeros((*a.shape, e + 1), a.dtype)
    out[..., 0] = a
    for j in range(e):
        v = out.reshape(*a.shape[:-1], n >> (j + 1), 2, 1 << j, e + 1)
        clear, there = v[..., 0, :, :].copy(), v[..., 1, :, :].copy()
        v[..., 0, :, :] = clear + there
        v[..., 1, :, :] = clear
        v[..., 1, :, 1:] += there[..., :-1]
    return out
