"""Locally consistent symbols over words, by recompression."""

from __future__ import annotations

import numpy as np
import pandas as pd

U = np.uint64
_BASE = U(0x9E3779B97F4A7C13)  # odd, 3 modulo 8
#: Name of what stands between texts.
BREAK = U(0)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * _MIX[0]
    x = x ^ (x >> U(27))
    x = x * _MIX[1]
    return x ^ (x >> U(31))


def word_names(words: list[bytes]) -> np.ndarray:
    """64-bit names of words, the same in every task."""
    if not words:
        return np.zeros(0, U)
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


class Sums:
    """Names of any stretch of a sequence from prefix sums."""

    _powers = np.ones(1, U)
    _inverse = np.ones(1, U)

    def __init__(self, names: np.ndarray) -> None:
        n = len(names) + 1
        if len(Sums._powers) < n:
            size = max(n, 2 * len(Sums._powers))
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            for attribute, base in (("_powers", _BASE), ("_inverse", inverse)):
                steps = np.full(size, base, U)
                steps[0] = U(1)
                setattr(Sums, attribute, np.cumprod(steps, dtype=U))
        self.sums = np.zeros(n, U)
        np.cumsum(names * Sums._inverse[: n - 1], dtype=U, out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Name of ``[start, end)``: equal stretches, equal names."""
        value = (self.sums[end] - self.sums[start]) * Sums._powers[start]
        return mix(value + (end - start).astype(U) * _MIX[0])


def symbols(names: np.ndarray, rounds: int, longest: int) -> list[tuple[np.ndarray, ...]]:
    """``(level, name, start, needs from, needs to)`` arrays of the symbols made in each round.

    Round 1 first joins each run of one word (of at most ``longest`` words) into a symbol.
    Every round then joins a symbol of the left half of the names with a following one of
    the right half; the half is a bit of the name. A symbol depends on nothing outside the
    words it needs (its own and those that could have joined otherwise), so wherever these
    words stand the same symbol stands with them. What stands at an end of the sequence
    needs a word beyond it.
    """
    n = len(names)
    out = []
    name, start = names, np.arange(n)
    left, right = start.copy(), start + 1  # words that each symbol needs
    if n > 1:
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        size = np.diff(np.r_[first, n])
        joined = (size > 1) & (size <= longest)
        single = (size == 1) | joined
        # runs that stay apart keep their words
        keep = np.repeat(single, size)
        is_first = np.zeros(n, bool)
        is_first[first] = True
        chosen = is_first | ~keep
        run = np.repeat(np.arange(len(first)), size)[chosen]
        name = np.where(
            joined[run], mix(names[chosen] + size[run].astype(U) * _MIX[1]), names[chosen]
        )
        start = np.flatnonzero(chosen)
        left, right = first[run] - 1, (first + size)[run] + 1
        made = joined[run]
        out.append((np.ones(made.sum(), np.int64), name[made], start[made], left[made], right[made]))
    for level in range(1, rounds + 1):
        if len(name) < 2:
            break
        half = (mix(name + U(level)) & U(1)).astype(bool)
        pair = ~half[:-1] & half[1:]
        head = np.r_[pair, False]
        tail = np.r_[False, pair]
        # a symbol that stays also needs the neighbour that it might have joined
        beyond_left = np.where(half, np.r_[-1, left[:-1]], left)
        beyond_right = np.where(half, right, np.r_[right[1:], n + 1])
        near_left = np.where(tail, left, np.minimum(left, beyond_left))
        near_right = np.where(head, right, np.maximum(right, beyond_right))
        at = np.flatnonzero(head)
        new = mix(name[at] * _BASE + mix(name[at + 1] + U(level)))
        name, stay = name.copy(), ~tail
        left_all, right_all = near_left, near_right
        left_all[at] = np.minimum(left[at], left[at + 1])
        right_all[at] = np.maximum(right[at], right[at + 1])
        name[at] = new
        out.append(
            (np.full(len(at), level, np.int64), new, start[at], left_all[at], right_all[at])
        )
        name, start, left, right = name[stay], start[stay], left_all[stay], right_all[stay]
    return out


def segments(names: np.ndarray, width: int, rounds: int = 6, longest: int = 8):
    """``(name, first window, last window)`` arrays covering the windows of ``width`` words.

    Each window takes the symbol of highest level among those whose needs lie inside it
    (then of highest name, then leftmost), a bare word where there is none. The choice rests
    on the window's words alone: equal windows anywhere take equal symbols at equal places.
    Windows over a ``BREAK`` name (it stands between texts) are left out.
    """
    n = len(names)
    count = n - width + 1
    breaks = np.concatenate([[0], np.cumsum(names == BREAK)])
    valid = breaks[width:] == breaks[:count] if count > 0 else np.zeros(0, bool)
    if not valid.any():
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    made = [np.concatenate(c) for c in zip(*symbols(names, rounds, longest), strict=True)] or None
    words = (np.zeros(n, np.int64), names, np.arange(n), np.arange(n), np.arange(1, n + 1))
    best = np.zeros(count, np.int64)
    anchors = np.zeros(0, U)
    for group in (made, words):
        if group is None or (group is words and best[valid].all()):
            continue
        level, name, start, left, right = group
        low, high = np.maximum(right - width, 0), np.minimum(left, count - 1)
        use = (left >= 0) & (right <= n) & (low <= high)
        if group is words:  # only where a window is left without a symbol
            free = np.concatenate([[0], np.cumsum(valid & (best == 0))])
            use[use] = free[high[use] + 1] > free[low[use]]
        level, name, start, low, high = (x[use] for x in (level, name, start, low, high))
        order = np.lexsort((-start, name, level))
        value = np.empty(len(order), np.int64)
        value[order] = np.arange(len(order)) + 1
        # a range of windows is two ranges of a power of two; halved layer by layer
        step = np.frexp(high - low + 1)[1] - 1
        layer = np.zeros(count, np.int64)
        for k in range(int(step.max(initial=0)), -1, -1):
            above, half = layer, 1 << k
            layer = above.copy()
            np.maximum(layer[half:], above[: max(0, count - half)], out=layer[half:])
            here = np.flatnonzero(step == k)
            np.maximum.at(layer, low[here], value[here])
            np.maximum.at(layer, high[here] - half + 1, value[here])
        best = np.where((best == 0) & (layer > 0), layer + len(anchors), best)
        anchors = np.concatenate([anchors, name[order]])
    best[~valid] = 0
    edge = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    last = np.r_[edge[1:], count] - 1
    kept = best[edge] > 0
    return anchors[best[edge][kept] - 1], edge[kept], last[kept]
