"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Every round inserts one symbol per string, from the strings' ends to their starts: after
round t the list holds all suffixes of up to t symbols in sorted order, as the symbol
before each suffix (the transform) and the number of symbols each suffix shares with its
predecessor. A suffix's new place follows from the rank of its first symbol in the
transform; its common prefixes from the least common prefix between the two places that
the equal symbols come from. Transform and common prefixes live in two files, read and
written from front to back in each round.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0  # the symbol before a whole string; real symbols start at 1


class _Column:
    """A file that is read and rewritten as a whole, front to back, in each round."""

    def __init__(self, folder: str, name: str, dtype) -> None:
        self.path, self.dtype = os.path.join(folder, name), dtype

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, self.dtype)

    def write(self, values: np.ndarray) -> None:
        values.astype(self.dtype, copy=False).tofile(self.path)


class _Least:
    """Least values of ranges of an array, by a table over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-half], x[half:]))

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each range first..last, both included."""
        k = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.nonzero(k == level)[0]
            x = self.levels[level]
            out[at] = np.minimum(x[first[at]], x[last[at] - (1 << int(level)) + 1])
        return out


def build(symbols: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes up to ``cap``) of the strings symbols[ends[i-1]:ends[i]].

    Symbols are 1..65535; every string has its own end, smaller than all symbols.
    """
    ends = np.asarray(ends, np.int64)
    sizes = np.diff(ends, prepend=0)
    m = len(sizes)
    with tempfile.TemporaryDirectory() as folder:
        transform, common = _Column(folder, "transform", np.uint16), _Column(folder, "common", np.uint8)
        first = np.zeros(m, np.uint16)
        first[sizes > 0] = symbols[ends[sizes > 0] - 1]
        transform.write(first)
        common.write(np.zeros(m, np.uint8))
        place, active = np.arange(m), np.nonzero(sizes > 0)[0]
        t = 0
        while len(active):
            t += 1
            bwt, lcp = transform.read(), common.read()
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(len(bwt), np.int64)
            rank[order] = np.arange(len(bwt))
            here = place[active]
            r, symbol = rank[here], bwt[here]
            new = m + r - np.count_nonzero(bwt == END)
            least = _Least(lcp)
            # Common prefix with the suffix before: one symbol and what the two places share.
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
            same = (r > 0) & (bwt[before] == symbol)
            shared = np.zeros(len(active), np.int64)
            shared[same] = least.over(before[same] + 1, here[same]).astype(np.int64) + 1
            follow = (r + 1 < len(order)) & (bwt[after] == symbol)
            shared_after = least.over(here[follow] + 1, after[follow]).astype(np.int64) + 1

            left = sizes[active] > t
            symbol = np.where(left, symbols[np.maximum(ends[active] - 1 - t, 0)], END).astype(np.uint16)
            by = np.argsort(new)
            at = new[by] - np.arange(len(by))
            transform.write(np.insert(bwt, at, symbol[by]))
            lcp = np.insert(lcp, at, np.minimum(shared, cap)[by].astype(np.uint8))
            lcp[new[follow] + 1] = np.minimum(shared_after, cap)
            common.write(lcp)
            place[active] = new
            active = active[left]
        return transform.read(), common.read()


def repeated_suffixes(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` symbols from each place of ``symbols`` also start elsewhere."""
    ends = np.asarray(ends, np.int64)
    bwt, lcp = build(symbols, ends, depth)
    sizes, m = np.diff(ends, prepend=0), len(ends)
    deep = lcp >= depth
    deep[:-1] |= deep[1:].copy()
    order = np.argsort(bwt, kind="stable")
    forward = np.empty(len(bwt), np.int64)
    forward[order] = np.arange(len(bwt)) + m - np.count_nonzero(bwt == END)
    out = np.zeros(len(symbols), bool)
    place, active, t = np.arange(m), np.nonzero(sizes > 0)[0], 0
    while len(active):  # walk from the end of every string to its start
        t += 1
        place[active] = forward[place[active]]
        out[ends[active] - t] = deep[place[active]]
        active = active[sizes[active] > t]
    return out
