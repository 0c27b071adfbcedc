"""Content-defined anchors: where texts that share a long string must meet.

Every window of ``window`` bytes names as its anchor the ``k`` bytes in it with
the smallest hash (the leftmost of equals).  Equal windows name equal anchors at
the same place, wherever they stand, so all copies of a long string can be
brought together by the anchor's hash alone.  Consecutive windows with one
anchor form a *segment*: the bytes of all of them.
"""

from __future__ import annotations

import numpy as np

from frametally.llm import bytekernels as bk

#: Low bits of an ordering value hold the position, which breaks ties to the left.
_PLACE = 28
_LOW = np.uint64((1 << _PLACE) - 1)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def segments(buf: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, anchor, first start, last start, segment hash) of every
    segment of a chunk; places are bytes from the text's start."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
    if len(buf) < window or np.diff(offsets).max() < window:
        return empty
    sums = bk.prefix_sums(buf)
    n = len(buf) - k + 1
    with np.errstate(over="ignore"):
        h = sums[k:] - sums[:-k]
        h *= bk._power(bk._BASE_INV, len(sums), "down")[:n]
        h *= np.uint64(0xFF51AFD7ED558CCD)
    at = np.arange(n, dtype=np.uint64)
    order = (h & ~_LOW) | (at & _LOW)
    low = _sliding_min(order, window - k + 1) & _LOW
    start = np.arange(len(low))
    anchor = (start & ~int(_LOW)) + low.astype(np.int64)
    anchor[anchor < start] += 1 << _PLACE
    # a start is valid when its window ends inside its text
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)[: len(low)]
    valid = start + window <= offsets[1:][text]
    edge = np.ones(len(low), dtype=bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(edge & valid)
    if not len(first):
        return empty
    stop = np.ones(len(low), dtype=bool)
    stop[:-1] = edge[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    a, t = anchor[first], text[first]
    base = offsets[:-1][t]
    return t, h[a], a - base, first - base, last - base, bk.range_hash(sums, first, last + window)
