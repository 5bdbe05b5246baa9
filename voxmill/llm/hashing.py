"""Vectorised 64-bit names of the words of a byte string."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(2 * n, 1 << 16)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; several times faster here than numpy's hashed form."""
    a = np.sort(a)
    return a[np.diff(a, prepend=~a[:1]) != 0]


def word_names(raw: np.ndarray, in_word: np.ndarray, gaps: np.ndarray | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names and start offsets of the runs of bytes for which `in_word` (a table of 256) holds.

    A name is a polynomial of the word's bytes, taken from running sums over the whole array,
    so equal words have equal names wherever they stand. Three bytes from an offset in `gaps` on
    are no word, and from one in `alone` on a word of their own.
    """
    held = in_word[raw]
    if gaps is not None and len(gaps):
        held[np.concatenate([gaps, gaps + 1, gaps + 2])] = False
    edge = np.flatnonzero(np.diff(held, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if alone is not None and len(alone):
        edge = np.unique(np.concatenate([edge, alone, alone + 3]))
        own = held[np.minimum(edge[:-1], len(raw) - 1)]
        start, end = edge[:-1][own], edge[1:][own]
    if not len(start):
        return np.zeros(0, np.uint64), start
    power, back = _powers_to(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _MIX), start
