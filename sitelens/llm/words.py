"""Hashes of words and of word shingles of many texts at once, on flat numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z on demand. Its hash is a polynomial over random 64-bit
values of its bytes (prefix sums make all words of a batch cost a few operations a byte), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BASE = np.uint64(0x9DDFEA08EB382D69)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on uint64."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def parts(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes of text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1))
        yield first, last
        first = last


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the range of words (n + 1 offsets) of each row."""
    n = len(data)
    space = separator[data]
    starts = ~space
    starts[1:] &= space[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts[edges] = ~space[edges]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[edges - 1] = ~space[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * power[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * inverse[first])
    return hashes, first, last, np.searchsorted(first, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row with repeats, and their ranges; with whole, rows of fewer words give one shingle."""
    n = len(hashes)
    count = np.diff(rows)
    size = np.maximum(count - k + 1, (count > 0).astype(np.int64) if whole else 0)
    ranges = np.concatenate([[0], np.cumsum(size)])
    total = int(ranges[-1])
    if not total:
        return np.zeros(0, np.uint64), ranges
    long = count >= k
    at = np.arange(total) + np.repeat(rows[:-1] - ranges[:-1], size)
    if n >= k:
        every = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            every += hashes[j : n - k + 1 + j] * _PLACE[j]
        out = mix(every)[np.minimum(at, n - k)]
    else:
        out = np.zeros(total, dtype=np.uint64)
    for i in np.flatnonzero(~long & (size > 0)):
        words = hashes[rows[i] : rows[i + 1]]
        out[ranges[i]] = mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[63:] * np.uint64(len(words)))[0]
    return out, ranges
