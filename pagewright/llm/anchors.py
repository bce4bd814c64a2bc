"""Content-defined segments of sequences, shared by the substring operators.

Every window of ``window`` items is keyed by the least hash among its grams of ``gram`` items; a
segment is a maximal run of neighbouring windows with one key.  Equal windows have equal keys, so
windows only need comparing within a key, and a segment's own digest settles whole segments at once.
"""

from __future__ import annotations

import numpy as np

from .hashing import grams, mix


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbouring values, by doubling."""
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < size:
        out = np.minimum(out[: len(values) - size + 1], out[size - span :])
    return out


def segments(items: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Segments of the documents whose items lie at ``first[i]`` to ``first[i + 1]``.

    Returns (document, first item, number of windows, key, whether the key's gram occurs more than once in the
    segment, so that windows within it may repeat each other)."""
    n = len(items)
    width = window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    g = mix(grams(items, gram) ^ np.uint64(0x5851F42D4C957F2D))
    v = sliding_min(g, width)  # a key for every window of the whole slice
    lengths = np.diff(first)
    valid = np.zeros(n - window + 1, bool)
    edge = np.zeros(n + 1, np.int32)
    has = lengths >= window
    np.add.at(edge, first[:-1][has], 1)
    np.add.at(edge, first[1:][has] - window + 1, -1)
    valid = np.cumsum(edge[: n - window + 1]) > 0
    new = np.empty(len(v), bool)
    new[0], new[1:] = True, v[1:] != v[:-1]
    new[first[:-1][has]] = True
    gap = np.ones(len(v) + 1, bool)
    gap[1:] = ~valid
    new |= gap[:-1]
    start = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    count = stop - start
    doc = np.searchsorted(first, start, "right") - 1
    # Does the key's gram occur twice in the segment?  Compare all grams that the segment's windows cover.
    cover = count + width - 1
    begin = np.cumsum(cover) - cover
    twice = np.zeros(len(start), bool)
    step = 1 << 20
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + step, "right")) - 1) if begin[-1] > begin[lo] + step else len(start)
        at = np.arange(int(cover[lo:hi].sum())) + np.repeat(start[lo:hi] - (begin[lo:hi] - begin[lo]), cover[lo:hi])
        twice[lo:hi] = np.add.reduceat(g[at] == np.repeat(v[start[lo:hi]], cover[lo:hi]), begin[lo:hi] - begin[lo], dtype=np.int64) > 1
        lo = hi
    return doc, start, count, v[start], twice
