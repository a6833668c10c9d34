"""Counting pairs without forming them: n log n kernels on arrays, for one task's share of the rows."""

from __future__ import annotations

import numpy as np


def dominated(values: np.ndarray, first: np.ndarray, below: np.ndarray) -> int:
    """Over all queries j the sum of how many of the ``first[j]`` leading entries of ``values`` are among the
    ``below[j]`` smallest (equal values in order), by a wavelet matrix."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    lo, hi, found = np.zeros(len(first), np.int64), first.astype(np.int64), 0
    for bit in range(n.bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (below >> bit & 1).astype(bool)
        zlo, zhi = zeros[lo], zeros[hi]
        found += int((zhi - zlo)[up].sum())
        lo, hi = np.where(up, zeros[-1] + lo - zlo, zlo), np.where(up, zeros[-1] + hi - zhi, zhi)
        rank = np.concatenate([rank[~one], rank[one]])
    return found


def inversions(t: np.ndarray, h: np.ndarray) -> int:
    """Pairs with t_a < t_b and h_a > h_b."""
    order = np.argsort(t, kind="stable")
    t, h = t[order], h[order]
    first = np.searchsorted(t, t, "left")
    return int(first.sum()) - dominated(h, first, np.searchsorted(np.sort(h), h, "right"))


def overlaps(l, r, b, t, asked) -> int:  # noqa: E741
    """Pairs of rectangles (l, r) x (b, t), all of positive size, that share an inner point and of which the one that
    starts last on the first axis is ``asked``."""

    def both(bottom, top, first, low, high) -> int:
        under = np.searchsorted(np.sort(bottom), high, "left")  # begins below the other's top ...
        past = np.searchsorted(np.sort(top), low, "right")  # ... less those that end by its bottom
        return dominated(bottom, first, under) - dominated(top, first, past)

    order = np.argsort(l, kind="stable")
    ask = np.flatnonzero(asked[order])
    low, high = b[order][ask], t[order][ask]
    begun = both(b[order], t[order], ask, low, high)
    ends = np.argsort(r, kind="stable")
    return begun - both(b[ends], t[ends], np.searchsorted(r[ends], l[order][ask], "right"), low, high)
