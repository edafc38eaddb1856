"""The E8 lattice: nearest points and neighbouring cells, for many vectors at once."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors of length sqrt(2): the steps to neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out.extend(np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0)
    return np.array(out)


STEPS = shortest_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.nonzero(near.sum(1).astype(np.int64) & 1)[0]
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the better of the two even cosets."""
    p, q = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - p) ** 2).sum(1) <= ((x - q) ** 2).sum(1))[:, None], p, q)


def neighbours(x: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` neighbouring cells nearest to each row: rows x n x 8."""
    gain = (x - cell) @ STEPS.T
    best = np.argpartition(-gain, n - 1, axis=1)[:, :n]
    return cell[:, None, :] + STEPS[best]
