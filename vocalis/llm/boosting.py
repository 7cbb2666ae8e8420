"""Gradient-boosted trees over a cube of small integer features: fitted from counts, applied as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 24
RATE = 0.4


@dataclass
class Tree:
    """A split (feature, at most), then one split on each side, then leaves: (feature, cut, (feature, cut, leaf, leaf), ...)."""

    root: tuple

    def sql(self, names: list[str]) -> str:
        def walk(node) -> str:
            if not isinstance(node, tuple):
                return f"{node:.9g}D"
            f, cut, low, high = node
            return f"if({names[f]} <= {cut}, {walk(low)}, {walk(high)})"

        return walk(self.root)

    def apply(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            f, cut, low, high = node
            left = x[rows, f] <= cut
            out = np.empty(len(rows))
            out[left], out[~left] = walk(low, rows[left]), walk(high, rows[~left])
            return out

        return walk(self.root, np.arange(len(x)))


def _split(x, g, h, rows, depth):
    gain, best = 1e-9, None
    leaf = float(-g[rows].sum() / (h[rows].sum() + 1.0) * RATE)
    if depth == 0 or not len(rows):
        return leaf
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1]:
            low = x[rows, f] <= cut
            gl, hl = g[rows[low]].sum(), h[rows[low]].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            got = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
            if got > gain:
                gain, best = got, (f, int(cut))
    if best is None:
        return leaf
    low = x[rows, best[0]] <= best[1]
    return (*best, _split(x, g, h, rows[low], depth - 1), _split(x, g, h, rows[~low], depth - 1))


def fit(x: np.ndarray, n: np.ndarray, pos: np.ndarray, trees: int = TREES) -> tuple[list[Tree], np.ndarray]:
    """x: distinct feature rows; n: how often each occurs; pos: how often it is positive. Trees, and scores of x."""
    margin, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = n * p - pos, n * p * (1 - p)
        tree = Tree(_split(x, g, h, np.arange(len(x)), 3))
        out.append(tree)
        margin += tree.apply(x)
    return out, margin


def calibrated(margin: np.ndarray, n: np.ndarray, pos: np.ndarray, precision: float) -> float:
    """The least margin down to which every level of equal margin keeps this precision by itself; infinite if the
    highest does not. Levels are judged alone, so many sure rows do not carry doubtful ones; levels without rows are no
    evidence and passed over."""
    best = np.inf
    for level in np.unique(margin[n > 0])[::-1]:
        at = margin == level
        if pos[at].sum() < precision * n[at].sum():
            break
        best = level
    return float(best)
