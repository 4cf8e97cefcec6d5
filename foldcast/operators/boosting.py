"""Boosted regression trees on histograms, for one cell of a grid (M4): absolute loss, leaf-wise growth, early stop.

A cell has one asset's sessions of a fold. Features are binned once; a tree splits the leaf that gains most until it has
``leaves`` of them. Gradients are signs of residuals, a leaf's value is the median of its residuals times ``rate``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Params:
    """``least`` rows a leaf at least; ``rounds`` without gain end a fit of at most ``most`` trees; ``bins`` a feature."""

    leaves: int = 15
    least: int = 20
    rate: float = 0.03
    l2: float = 1.0
    rounds: int = 50
    most: int = 1000
    bins: int = 64


@dataclass
class Tree:
    """Nodes by number: feature (-1 in a leaf), last bin of the left side, children, value."""

    feature: list[int] = field(default_factory=list)
    upto: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self) -> int:
        for part, v in ((self.feature, -1), (self.upto, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part.append(v)
        return len(self.feature) - 1

    def predict(self, codes: np.ndarray) -> np.ndarray:
        feature, upto, left, right = (np.array(x) for x in (self.feature, self.upto, self.left, self.right))
        at = np.zeros(len(codes), np.int64)
        while len(open_ := np.flatnonzero(feature[at] >= 0)):
            node = at[open_]
            at[open_] = np.where(codes[open_, feature[node]] <= upto[node], left[node], right[node])
        return np.array(self.value)[at]


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the upper edges of all bins but the last: midpoints between values, thinned to quantiles where there are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], 1) if len(cuts) else np.zeros((len(x), 0), np.int64)


def _best_split(grad: np.ndarray, n: np.ndarray, p: Params) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) from histograms, features x bins; the first of equal gains. Gain 0: no split."""
    g, m = grad.cumsum(1), n.cumsum(1)
    total, rows = g[0, -1], m[0, -1]
    gain = g**2 / (m + p.l2) + (total - g) ** 2 / (rows - m + p.l2) - total**2 / (rows + p.l2)
    gain[(m < p.least) | (rows - m < p.least)] = 0
    best = int(gain.argmax())
    return float(gain.flat[best]), best // n.shape[1], best % n.shape[1]


def grow(codes: np.ndarray, residual: np.ndarray, p: Params) -> tuple[Tree, np.ndarray]:
    """A tree on residuals, and its values on its own rows."""
    rows, n_features = codes.shape
    flat = codes + np.arange(n_features) * p.bins
    sign = np.sign(residual)

    def histogram(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = flat[own].ravel()
        shape = n_features, p.bins
        return np.bincount(at, np.repeat(sign[own], n_features), n_features * p.bins).reshape(shape), np.bincount(at, minlength=n_features * p.bins).reshape(shape)

    tree, own = Tree(), np.arange(rows)
    made = histogram(own)
    leaves = {tree.leaf(): (own, made, _best_split(*made, p) if n_features else (0.0, 0, 0))}
    while len(leaves) < p.leaves:
        node = max(leaves, key=lambda k: (leaves[k][2][0], -k))
        own, made, (gain, feature, upto) = leaves[node]
        if gain <= 1e-12:
            break
        del leaves[node]
        left = codes[own, feature] <= upto
        sides = own[left], own[~left]
        small = int(len(sides[1]) < len(sides[0]))
        counted = histogram(sides[small])
        rest = tuple(a - b for a, b in zip(made, counted))
        tree.feature[node], tree.upto[node] = feature, upto
        children = tree.leaf(), tree.leaf()
        tree.left[node], tree.right[node] = children
        for k, child in enumerate(children):
            own_made = counted if k == small else rest
            leaves[child] = (sides[k], own_made, _best_split(*own_made, p))
    told = np.zeros(rows)
    for node, (own, _, _) in leaves.items():
        tree.value[node] = p.rate * float(np.median(residual[own])) if len(own) else 0.0
        told[own] = tree.value[node]
    return tree, told


@dataclass
class Ensemble:
    """A fitted model; ``errors`` are the mean absolute errors of the stopping rows after each tree that was grown."""

    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    errors: list[float]
    stopped: bool

    @property
    def best_iteration(self) -> int:
        return len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = binned(x, self.cuts)
        return self.base + sum((t.predict(codes) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, p: Params, frozen: int | None = None) -> Ensemble:
    """Fit on (x, y). Rows (vx, vy) stop the fit, and the ensemble is cut to its first least error there; with ``frozen`` there is
    no stop and so many trees are grown."""
    cuts = edges(x, p.bins)
    codes, vcodes = binned(x, cuts), binned(vx, cuts)
    base = float(np.median(y))
    told, vtold = np.full(len(y), base), np.full(len(vy), base)
    trees, errors, best, stopped = [], [], 0, False
    for k in range(p.most if frozen is None else frozen):
        tree, own = grow(codes, y - told, p)
        trees.append(tree)
        told = told + own
        if frozen is not None:
            continue
        vtold = vtold + tree.predict(vcodes)
        errors.append(float(np.abs(vtold - vy).mean()))
        if errors[k] < errors[best]:
            best = k
        elif k - best >= p.rounds:
            stopped = True
            break
    return Ensemble(cuts, base, trees if frozen is not None else trees[: best + 1], errors, stopped)
