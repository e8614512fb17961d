"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return, with A-Z taken as a-z.  A text is never made into
Python strings: word starts come from a mask, and each hash is a difference of
two prefix sums of a polynomial over the bytes (modulo 2**64), mixed at the end.
Work arrays are bounded by PIECE bytes of text, except for one longer word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SLICE = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finalizer; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row, and of at most ``rows`` rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words) for texts of ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] |= solid[edges]
    stop[edges - 1] |= solid[edges - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    counts = np.searchsorted(first, offsets)
    out = np.empty(len(first), np.uint64)
    table = _BYTES[LOWER] if lower else _BYTES
    i = 0
    while i < len(first):
        j = int(np.searchsorted(last, first[i] + PIECE, "right"))
        j = max(j, i + 1)
        a, b = int(first[i]), int(last[j - 1]) + 1
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[a:b]] * _power(_BASE, b - a)[: b - a], out=sums[1:])
        lo = first[i:j] - a
        out[i:j] = mix((sums[last[i:j] + 1 - a] - sums[lo]) * _power(_INVERSE, b - a)[lo])
        i = j
    return out, counts


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingles; fewer words than k make one
    shingle, no words none."""
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled = mix(rolled * np.uint64(3) + hashes[i : n - k + 1 + i] + np.uint64(i + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = mix(h * np.uint64(3) + hashes[i : i + 1] + np.uint64(101 + i - a))
            yield h
        else:
            yield np.zeros(0, np.uint64)
