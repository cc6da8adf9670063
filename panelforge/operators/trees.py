"""Regression trees on histograms, for thousands of small fits side by side in grouped tasks.

Features are binned once a fit.  A node's histogram holds the sums of gradients and weights by
feature and bin; of two children the smaller one is counted and the other is the difference to the
parent.  Trees grow leaf by leaf, the leaf with the highest gain first.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .moments import plain, side_by_side

BINS = 255
#: Gains are compared to so many places, so that equal splits are taken in order of feature and threshold.
PLACES = 12


@dataclass
class Bins:
    """Upper bounds of each feature's bins but the last: midpoints between values, or quantiles of many."""

    bounds: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Bins:
        bounds = []
        for c in x.T:
            v = np.unique(c)
            bounds.append((v[1:] + v[:-1]) / 2 if len(v) <= BINS else np.unique(np.quantile(c, np.arange(1, BINS) / BINS)))
        return cls(bounds)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, c, "left") for b, c in zip(self.bounds, x.T, strict=True)], axis=1).astype(np.int64) if x.shape[1] else np.zeros(x.shape, np.int64)


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(v)
        return len(self.value) - 1

    def predict(self, binned: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(binned), np.int64)
        while len(on := np.flatnonzero(feature[at] >= 0)):
            node = at[on]
            at[on] = np.where(binned[on, feature[node]] <= cut[node], left[node], right[node])
        return np.array(self.value)[at]


def grow(binned: np.ndarray, y: np.ndarray, weight: np.ndarray, leaves: int, depth: int, least: int, pick=None) -> Tree:
    """A least-squares tree; rows count by weight, `least` of it stays in each leaf; pick(p) says which features a node may use."""
    n, p = binned.shape
    width = int(binned.max(initial=0)) + 1
    flat = binned + np.arange(p) * width
    tree = Tree()

    # Gradients and weights of every cell, so that a node's histogram is two counts.
    weighted, weights = np.repeat((weight * y)[:, None], p, axis=1), np.repeat(weight[:, None], p, axis=1)

    def histogram(rows: np.ndarray) -> np.ndarray:
        at = flat[rows].ravel()
        return np.stack([np.bincount(at, v[rows].ravel(), p * width).reshape(p, width) for v in (weighted, weights)])

    def best(h: np.ndarray) -> tuple[float, int, int]:
        total, count = h[0, 0].sum(), h[1, 0].sum()
        if count < 2 * least or width < 2:
            return 0.0, -1, 0
        g, w = h.cumsum(axis=2)[:, :, :-1]
        ok = (w >= least) & (w <= count - least)
        if pick is not None:
            ok &= np.isin(np.arange(p), pick(p))[:, None]
        at = np.flatnonzero(ok)
        if not len(at):
            return 0.0, -1, 0
        g, w = g.ravel()[at], w.ravel()[at]
        gain = (g * g / w + (total - g) ** 2 / (count - w) - total * total / count).round(PLACES)
        k = int(gain.argmax())
        f, b = divmod(int(at[k]), width - 1)
        return (float(gain[k]), f, b) if gain[k] > 0 else (0.0, -1, 0)

    queue: list = []

    def put(rows: np.ndarray, h: np.ndarray, level: int) -> int:
        total, count = h[0, 0].sum(), h[1, 0].sum()
        node = tree.add(float(total / count) if count else 0.0)
        gain, f, b = best(h) if level < depth else (0.0, -1, 0)
        if f >= 0:
            heapq.heappush(queue, (-gain, node, f, b, level, rows, h))
        return node

    rows = np.flatnonzero(weight > 0)
    if not p or not len(rows):
        tree.add(float(np.average(y, weights=weight)) if weight.sum() else 0.0)
        return tree
    put(rows, histogram(rows), 0)
    made = 1
    while queue and made < leaves:
        _, node, f, b, level, rows, h = heapq.heappop(queue)
        low = binned[rows, f] <= b
        small, large = (rows[low], rows[~low]) if low.sum() <= len(rows) / 2 else (rows[~low], rows[low])
        part = histogram(small)
        sides = {True: (small, part), False: (large, h - part)}
        first = low.sum() <= len(rows) / 2
        tree.feature[node], tree.bin[node] = f, b
        tree.left[node] = put(*sides[first], level + 1)
        tree.right[node] = put(*sides[not first], level + 1)
        made += 1
    return tree


def boosted(x: np.ndarray, y: np.ndarray, test: np.ndarray, rounds: int = 200, rate: float = 0.05, leaves: int = 15, least: int = 20) -> np.ndarray:
    """Predictions of gradient boosting for squared loss."""
    bins = Bins.of(x)
    a, b = bins.apply(x), bins.apply(test)
    level = float(y.mean())
    fit, out, one = np.full(len(y), level), np.full(len(test), level), np.ones(len(y))
    for _ in range(rounds):
        tree = grow(a, y - fit, one, leaves, 1 << 30, least)
        if len(tree.value) == 1:
            break
        fit += rate * tree.predict(a)
        out += rate * tree.predict(b)
    return out


def forest(x: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int = 50, depth: int = 4, share: float = 0.5, least: int = 20, seed: int = 42) -> np.ndarray:
    """Mean prediction of trees on drawn rows; each node may use a share of the features."""
    rng = np.random.default_rng(seed)
    bins = Bins.of(x)
    a, b = bins.apply(x), bins.apply(test)
    out = np.zeros(len(test))
    for _ in range(trees):
        weight = np.bincount(rng.integers(len(y), size=len(y)), minlength=len(y)).astype(float)
        tree = grow(a, y, weight, 1 << 30, depth, least, lambda p: rng.choice(p, max(1, int(share * p)), replace=False))
        out += tree.predict(b)
    return out / trees


def sector_features(pdf: pd.DataFrame, signals: list[str]) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """Of one sector's rows (t, ticker, signals, y): the date's signals of all names and the name's own place, for
    each (date, name); missing signals are 0, missing y is NaN."""
    names = sorted(pdf["ticker"].unique())
    wide = [pdf.pivot_table(index="t", columns="ticker", values=s, dropna=False).reindex(columns=names).sort_index() for s in signals]
    y = pdf.pivot_table(index="t", columns="ticker", values="y", dropna=False).reindex(index=wide[0].index, columns=names)
    flat = np.nan_to_num(np.concatenate([w.to_numpy(float) for w in wide], axis=1))
    x = np.concatenate([np.repeat(flat, len(names), axis=0), np.tile(np.arange(len(names), dtype=float), len(flat))[:, None]], axis=1)
    return x, [(t, n) for t in wide[0].index for n in names], y.to_numpy(float).ravel()


def fit_each(rows: DataFrame, model, signals: list[str], *by: str, flatten: bool, least_rows: int, least_names: int = 1) -> DataFrame:
    """(by..., t, ticker, score): a model refitted in every group on rows that aren't `test`, applied to those that are.

    rows: (by..., t, ticker, signals..., y, test).  With `flatten` a row's features are all names' signals of its date
    and its name's place, else its own signals; rows without them are passed over.  Groups with fewer training rows
    or names than asked for have no scores.
    """
    kinds = dict(rows.dtypes)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        late = {(t, n) for t, n, x in zip(pdf["t"], pdf["ticker"], pdf["test"], strict=True) if x}
        if flatten:
            early = set(pdf.loc[~pdf["test"], "ticker"])
            x, names, y = sector_features(pdf[pdf["ticker"].isin(early)], signals) if early else (np.zeros((0, 1)), [], np.zeros(0))
        else:
            pdf = pdf.dropna(subset=signals).sort_values(["t", "ticker"])
            x, names, y = pdf[signals].to_numpy(float), list(zip(pdf["t"], pdf["ticker"], strict=True)), pdf["y"].to_numpy(float)
        first = min((t for t, _ in late), default=None)
        train = np.array([first is None or t < first for t, _ in names], bool) & np.isfinite(y)
        test = np.array([n in late for n in names], bool)
        out = {b: [] for b in by} | {"t": [], "ticker": [], "score": []}
        if train.sum() >= least_rows and len({n for _, n in names}) >= least_names and test.any():
            score = model(x[train], y[train], x[test])
            at = [n for n, ok in zip(names, test, strict=True) if ok]
            out = {b: [k] * len(at) for b, k in zip(by, key, strict=True)} | {"t": [t for t, _ in at], "ticker": [n for _, n in at], "score": score}
        return plain(pd.DataFrame(out))

    return side_by_side(rows, *by).groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in by) + f", t {kinds['t']}, ticker string, score double")
