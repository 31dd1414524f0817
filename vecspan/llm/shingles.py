"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from .common import slices

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20_11)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x):
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base, n: int):
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data, offsets):
    """(hash, text number) of every word of the texts; words never cross texts."""
    gap = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | first[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | first[1:])) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:], dtype=np.uint64)
    h = (total[ends] - total[starts]) * powers(_BACK, len(data) + 1)[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data, offsets, words: int = 5):
    """The sorted distinct shingle hashes of each text, in order.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    for i, j in slices(offsets, 1 << 20):
        part = offsets[i : j + 1] - offsets[i]
        h, at = word_hashes(data[offsets[i] : offsets[j]], part)
        counts = np.bincount(at, minlength=j - i)
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s += h[k : k + n] * _STEP[k]
        s = mixed(s)
        begin = np.concatenate([[0], np.cumsum(counts)])
        for k in range(j - i):
            a, b = begin[k], begin[k + 1]
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                short = h[a:b] * _STEP[words : words + b - a]
                yield mixed(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield s[:0]
