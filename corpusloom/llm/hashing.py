"""Vectorised hashing of words, shingles and byte windows (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to at least ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        up = np.full(size, _P, dtype=np.uint64)
        down = np.full(size, _PINV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; differences times an inverse power are substring hashes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not in ``space``."""
    gap = np.empty(len(data) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    data = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    start, end = word_spans(data)
    return span_hashes(prefix_hash(data), start, end)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence is one if there are fewer words."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = mix64(acc * np.uint64(_P) + words[i : len(words) - k + 1 + i])
    return np.unique(acc)
