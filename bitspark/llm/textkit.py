"""Vectorised word hashing shared by the operators that leave the JVM.

A batch of texts becomes one byte buffer; words are runs of bytes outside
``0x20`` and ``0x09-0x0D``.  A word's 64-bit key is a polynomial over random
byte values, read off one cumulative sum, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
CHUNK_BYTES = 1 << 22
SEGMENT_BYTES = 1 << 20
_R = U(0x9E3779B97F4A7C15 | 5)

with np.errstate(over="ignore"):
    _INV = _R  # Newton iteration for the inverse of an odd number modulo 2^64
    for _ in range(6):
        _INV = _INV * (U(2) - _R * _INV)

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


_VALUES = _byte_values()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _R), ("down", _INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive UTF-8 texts of about ``limit`` bytes, with the index of the first; null is empty."""
    first, total, out = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if out and total + len(raw) > limit:
            yield first, out
            first, total, out = i, 0, []
        out.append(raw)
        total += len(raw) + 1
    if out:
        yield first, out


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts in order, and the index of each text's first word (one more at the end)."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~_SEP[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keys = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # a few words at a time: eight bytes of work space for each byte of them
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + SEGMENT_BYTES, "right")))
        part = data[low : ends[upto - 1]]
        first, last = starts[at:upto] - low, ends[at:upto] - low
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_VALUES[part] * up[:-1], out=total[1:])
        keys[at:upto] = mix((total[last] - total[first]) * down[first] + (last - first).astype(U) * U(0xA24BAED4963EE407))
        at = upto
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    return keys, np.searchsorted(starts, bounds)


def shingles(keys: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle keys; with fewer words the whole sequence is one; without words, none."""
    if len(keys) >= width:
        rolled = keys[: len(keys) - width + 1]
        for j in range(1, width):
            rolled = mix(rolled * U(0x9FB21C651E98DF25) + keys[j : len(keys) - width + 1 + j])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield distinct(rolled[a : b - width + 1])
        elif b > a:
            yield sequence_key(keys[a:b])[None]
        else:
            yield keys[:0]


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: numpy's own way with integers, a hash table, takes ten times as long on millions of keys."""
    run = np.sort(a)
    return run if len(run) < 2 else run[np.concatenate(([True], run[1:] != run[:-1]))]


def sequence_key(keys: np.ndarray) -> np.uint64:
    """One key for a short sequence of word keys, of its length too."""
    out = mix(np.array([len(keys)], U) * U(0xC2B2AE3D27D4EB4F))
    for k in keys:
        out = mix(out * U(0x9FB21C651E98DF25) + k)
    return out[0]


def set_key(keys: np.ndarray) -> np.int64:
    """Order-free key of a set of keys."""
    total = np.add.reduce(mix(keys ^ U(0x632BE59BD9B4E019))) if len(keys) else U(0)
    return mix(np.array([total], U) + U(len(keys)))[0].astype(np.int64)
