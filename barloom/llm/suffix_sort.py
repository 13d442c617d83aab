"""Suffix order of many short byte strings by hashed comparisons (numpy, inside a task).

A prefix polynomial hash of the joined bytes tells in constant time whether two stretches are
equal, so a binary search finds how far two suffixes agree, and a merge sort needs only
logarithmic comparisons.  All comparisons of a merge level run at once.  Every agreement
found between neighbours is verified on the bytes; if one was a collision, the strings are
sorted by their bytes instead.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = K.mix(np.arange(1, 257, dtype=np.uint64))


class Suffixes:
    """Strings ``parts``; order is by (group, bytes)."""

    def __init__(self, parts: list[bytes], groups: np.ndarray):
        self.parts, self.groups = parts, groups
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(parts) + b"\0", dtype=np.uint8)
        self.power = np.ones(len(self.data) + 1, np.uint64)
        if len(self.data):
            self.power[1:] = np.cumprod(np.full(len(self.data), _BASE, np.uint64))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(
            _VALUE[self.data] * self.power[:-1], dtype=np.uint64)])

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of strings x and y (arrays of numbers)."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.size[x], self.size[y])
        a, b = self.at[x], self.at[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            left = (self.prefix[a + mid] - self.prefix[a]) * self.power[b]
            right = (self.prefix[b + mid] - self.prefix[b]) * self.power[a]
            same = left == right
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.agree(x, y)
        bytes_less = np.where(
            (n < self.size[x]) & (n < self.size[y]),
            self.data[np.minimum(self.at[x] + n, len(self.data) - 1)]
            < self.data[np.minimum(self.at[y] + n, len(self.data) - 1)],
            (self.size[x] < self.size[y]) | ((self.size[x] == self.size[y]) & (x < y)))
        return np.where(self.groups[x] == self.groups[y], bytes_less,
                        self.groups[x] < self.groups[y])

    def _merge(self, order: np.ndarray, run: int) -> np.ndarray:
        """Merge neighbouring sorted runs: an element's place is its own rank plus its rank
        in the other run, found by binary search."""
        n, place = len(order), np.arange(len(order))
        block = place // (2 * run) * (2 * run)
        left = place - block < run
        other = np.where(left, block + run, block)
        low = np.minimum(other, n)
        high = np.minimum(np.where(left, block + 2 * run, block + run), n)
        first = low.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            goes = np.zeros(n, bool)
            goes[open_] = self.less(order[mid[open_]], order[open_])
            low = np.where(open_ & goes, mid + 1, low)
            high = np.where(open_ & ~goes, mid, high)
        own = place - np.where(left, block, block + run)
        out = np.empty_like(order)
        out[block + own + low - first] = order
        return out

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, agreement of each string with the one before it in its group)."""
        order, run = np.arange(len(self.parts)), 1
        while run < len(order):
            order, run = self._merge(order, run), 2 * run
        agree = np.zeros(len(order), np.int64)
        agree[1:] = np.where(self.groups[order[1:]] == self.groups[order[:-1]],
                             self.agree(order[1:], order[:-1]), 0)
        p = self.parts
        for i in np.flatnonzero(agree).tolist():
            x, y, n = p[order[i]], p[order[i - 1]], int(agree[i])
            if x[:n] != y[:n]:
                return self._plain()
        return order, agree

    def _plain(self) -> tuple[np.ndarray, np.ndarray]:
        p, g = self.parts, self.groups
        order = np.array(sorted(range(len(p)), key=lambda i: (g[i], p[i], i)))
        agree = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            x, y = p[order[i]], p[order[i - 1]]
            if g[order[i]] == g[order[i - 1]]:
                m = min(len(x), len(y))
                d = np.flatnonzero(np.frombuffer(x[:m], np.uint8) != np.frombuffer(y[:m], np.uint8))
                agree[i] = d[0] if len(d) else m
        return order, agree


def repeated_offsets(parts: list[bytes], anchor: np.ndarray, groups: np.ndarray,
                     window: int) -> list[list[int]]:
    """Of each part, the offsets at which a window occurs at two places of its group.

    A part is the surroundings of an anchor at ``anchor[i]``; the windows compared are those
    that hold the anchor at the same distance.  Returns flat pairs (from, to) of window
    starts in the part, ``to`` exclusive.  Groups are runs of equal numbers.

    A window with o bytes before the anchor is the same in two parts if they agree on
    o bytes to the left and on window - o to the right.  Both agreements come from a suffix
    order (of what follows the anchor, and of what precedes it, reversed): parts that agree
    on n bytes are neighbours in it.
    """
    right = Suffixes([p[a:] for p, a in zip(parts, anchor.tolist())], groups).sort()
    left = Suffixes([p[:a][::-1] for p, a in zip(parts, anchor.tolist())], groups).sort()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    least, most = np.maximum(window - (sizes - anchor), 0), anchor
    out: list[list[int]] = [[] for _ in parts]
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2:
            continue
        lo, hi = least[a:b], most[a:b]
        r_order, r_agree = right[0][a:b] - a, right[1][a:b]
        l_order, l_agree = left[0][a:b] - a, left[1][a:b]
        cuts = np.unique(np.concatenate([lo, hi + 1, l_agree + 1, window - r_agree]))
        cuts = cuts[(cuts >= lo.min()) & (cuts <= hi.max() + 1)]
        r_class, l_class = np.empty(b - a, np.int64), np.empty(b - a, np.int64)
        found: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
        for o, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            r_class[r_order] = np.cumsum(r_agree < window - o)
            l_class[l_order] = np.cumsum(l_agree < o)
            here = np.flatnonzero((lo <= o) & (o <= hi))
            _, back, n = np.unique(r_class[here] * (b - a + 1) + l_class[here],
                                   return_inverse=True, return_counts=True)
            for i in here[n[back] > 1].tolist():
                found[i].append((o, end))
        for i, spans in enumerate(found):
            for o, end in spans:   # o bytes before the anchor: the window starts o before it
                out[a + i] += [int(hi[i]) - end + 1, int(hi[i]) - o + 1]
    return out
