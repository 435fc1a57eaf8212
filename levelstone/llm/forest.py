"""A small random forest on numpy arrays: bootstrap rows, random feature subsets, Gini splits at quantiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            low = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
        return self.value[at]


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    best, found = 1e-9, None
    n, ones = len(y), y.sum()
    whole = ones * (n - ones) / n
    for f in features:
        column = x[:, f]
        cuts = np.unique(np.quantile(column, np.linspace(0.03, 0.97, 24), method="lower"))
        low = column[:, None] <= cuts
        n_low = low.sum(axis=0)
        one_low = (low & (y[:, None] > 0)).sum(axis=0)
        n_high, one_high = n - n_low, ones - one_low
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = whole - one_low * (n_low - one_low) / n_low - one_high * (n_high - one_high) / n_high
        gain = np.where((n_low >= 2) & (n_high >= 2), gain, -1)
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (int(f), float(cuts[gain.argmax()]))
    return found


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    nodes: list[list] = []
    some = max(1, round(x.shape[1] ** 0.5))

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if level < depth and 0 < share < 1 and len(rows) >= 4:
            split = _split(x[rows], y[rows], rng.choice(x.shape[1], some, replace=False))
            if split:
                low = x[rows, split[0]] <= split[1]
                nodes[me][:2] = split
                nodes[me][2] = add(rows[low], level + 1)
                nodes[me][3] = add(rows[~low], level + 1)
        return me

    add(np.arange(len(y)), 0)
    return Tree(*(np.array([n[i] for n in nodes]) for i in range(5)))


@dataclass
class Forest:
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' shares of label 1; 0.5 without trees."""
        if not len(x) or not self.trees:
            return np.full(len(x), 0.5)
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng, depth))
    return Forest(out)
