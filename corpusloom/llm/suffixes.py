"""Blockwise suffix sorting with a difference cover (numpy, on one bounded block of bytes).

Suffixes are sorted by their first 32 bytes, and what is still tied by ranks of a sample: positions
whose residue lies in a perfect difference set, so that for any two suffixes some common shift under
31 takes both to sampled positions. The sample's ranks are computed once for the block, by doubling.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set modulo 31; every residue but 0 is a difference of two members once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
HEAD = 32  # bytes that are compared directly at first
RANKED = 156  # bytes that a sample rank stands for: 32 doubled to 63, 125, then 156
TAIL = 48  # bytes that are compared directly at last
PADDING = 512

_IN = np.zeros(PERIOD, dtype=bool)
_IN[list(COVER)] = True
_SHIFT = np.zeros((PERIOD, PERIOD), dtype=np.int64)
for _a in range(PERIOD):
    for _b in range(PERIOD):
        _SHIFT[_a, _b] = next(d for d in range(PERIOD) if _IN[(_a + d) % PERIOD] and _IN[(_b + d) % PERIOD])


def words_at(block: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The 8 bytes from ``at + offset`` as numbers that sort like the bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(block, 8)
    return np.ascontiguousarray(eight[at + offset]).view(">u8").ravel().astype(np.uint64)


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by the keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(block: np.ndarray) -> np.ndarray:
    """For each position of the cover sample, the rank of its next ``RANKED`` bytes; -1 elsewhere and in the padding."""
    n = len(block) - PADDING
    sample = np.flatnonzero(_IN[np.arange(n + RANKED + PERIOD) % PERIOD])
    rank = np.full(len(block), -1, dtype=np.int64)
    rank[sample] = _ranks([words_at(block, sample, i) for i in range(0, HEAD, 8)])
    for step in (PERIOD, 2 * PERIOD, PERIOD):  # rank of h bytes at p, and at p + step: h + step bytes
        sample = sample[sample + step < len(block)]
        sample = sample[rank[sample + step] >= 0]
        pair = rank[sample] * (len(block) + 1) + rank[sample + step]
        fresh = np.unique(pair, return_inverse=True)[1].reshape(-1)
        rank = np.full(len(block), -1, dtype=np.int64)
        rank[sample] = fresh
    return rank


def classes(block: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class numbers of the suffixes ``at``, equal where the first ``length`` bytes are.

    ``block`` ends in ``PADDING`` bytes that no suffix's first ``length`` bytes reach. Suffixes are
    put in order by a three-way quicksort of all ties at once, each compared with its group's pivot
    by the ranks at the pair's common shift.
    """
    assert PERIOD + RANKED <= length <= RANKED + TAIL - 4 and len(at)
    group = _ranks([words_at(block, at, i) for i in range(0, HEAD, 8)])
    out = np.empty(len(at), dtype=np.int64)
    used = 0
    live = np.arange(len(at))
    rank = None
    rng = np.random.default_rng(len(at))
    while len(live):
        kinds, where, size = np.unique(group, return_inverse=True, return_counts=True)
        where = where.reshape(-1)
        alone = size[where] == 1
        out[live[alone]] = used + np.arange(int(alone.sum()))
        used += int(alone.sum())
        live, where = live[~alone], where[~alone]
        if not len(live):
            break
        if rank is None:
            rank = cover_ranks(block)
        mixed = rng.permutation(len(live))
        pivot = np.empty(len(kinds), dtype=np.int64)
        pivot[where[mixed]] = at[live[mixed]]
        p, q = at[live], pivot[where]
        shift = _SHIFT[p % PERIOD, q % PERIOD]
        sign = np.sign(rank[p + shift] - rank[q + shift])
        same = np.flatnonzero(sign == 0)
        for i in range(length - TAIL, length, 8):
            if not len(same):
                break
            a, b = words_at(block, p[same], i), words_at(block, q[same], i)
            differ = a != b
            sign[same[differ]] = np.where(a[differ] < b[differ], -1, 1)
            same = same[~differ]
        equal = sign == 0
        out[live[equal]] = used + where[equal]
        used += len(kinds)
        live, group = live[~equal], (where[~equal] * 2 + (sign[~equal] > 0)).astype(np.int64)
    return out
