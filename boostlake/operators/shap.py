"""Attributions of one tree, vectorised over rows.

A leaf adds value * prod(o or z) over the distinct features of its path, o being whether the row follows the path at that
feature and z the share of training weight that does. Weights of coalitions are integrals of products of
(o t + z (1 - t)) over t from 0 to 1, which Gauss-Legendre points give exactly.
"""

from __future__ import annotations

import numpy as np

from boostlake.model import Tree


def _follows(t: Tree, node: int, x: np.ndarray) -> np.ndarray:
    """Whether each row goes left at a node."""
    v = x[:, t.feature[node]]
    missing = np.isnan(v)
    if node in t.categories:
        ok = (v >= 0) & (v < 16777216)
        left = ~(ok & np.isin(np.where(ok, v, -1).astype(np.int64), t.categories[node]))
    else:
        left = v < t.cond[node]
    return np.where(missing, t.default_left[node], left)


def _paths(t: Tree, x: np.ndarray, column: int):
    """For each leaf: value, features of its path, o (features x rows) and z."""
    left = {i: _follows(t, i, x) for i in range(t.n) if t.left[i] >= 0}
    for leaf, path in enumerate(t.paths()):
        if t.left[leaf] >= 0:
            continue
        one: dict[int, np.ndarray] = {}
        zero: dict[int, float] = {}
        for a, b in zip(path[:-1], path[1:], strict=True):
            f = int(t.feature[a])
            go = left[a] if b == t.left[a] else ~left[a]
            one[f] = go if f not in one else one[f] & go
            zero[f] = zero.get(f, 1.0) * (float(t.sum_hess[b]) / float(t.sum_hess[a]) if t.sum_hess[a] else 0.0)
        yield float(t.leaf[leaf, column]), list(one), np.array(list(one.values()), float).reshape(len(one), len(x)), np.array(list(zero.values()))


def mean_values(t: Tree, column: int = 0) -> np.ndarray:
    """Training-weighted mean leaf value below each node."""
    out = t.leaf[:, column].astype(np.float64).copy()
    for i in range(t.n - 1, -1, -1):
        if t.left[i] >= 0:
            a, b = t.left[i], t.right[i]
            out[i] = (out[a] * t.sum_hess[a] + out[b] * t.sum_hess[b]) / t.sum_hess[i] if t.sum_hess[i] else 0.0
    return out


def _without(factors: np.ndarray) -> np.ndarray:
    """Product of all factors but each one along the first axis."""
    n = len(factors)
    before, after = np.ones_like(factors), np.ones_like(factors)
    for i in range(1, n):
        before[i] = before[i - 1] * factors[i - 1]
        after[n - 1 - i] = after[n - i] * factors[n - i]
    return before * after


def exact(t: Tree, x: np.ndarray, m: int, column: int = 0) -> np.ndarray:
    """Shapley values (rows, m + 1); the last column is the mean value."""
    out = np.zeros((len(x), m + 1))
    for value, features, o, z in _paths(t, x, column):
        d = len(features)
        out[:, m] += value * z.prod()
        if not d:
            continue
        points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        for s, w in zip((points + 1) / 2, weights / 2, strict=True):
            rest = _without(o * s + (z * (1 - s))[:, None])
            for j, f in enumerate(features):
                out[:, f] += value * w * (o[j] - z[j]) * rest[j]
    return out


def interactions(t: Tree, x: np.ndarray, m: int, column: int = 0) -> np.ndarray:
    """Shapley interaction values (rows, m + 1, m + 1); rows sum up to the Shapley values."""
    out = np.zeros((len(x), m + 1, m + 1))
    for value, features, o, z in _paths(t, x, column):
        d = len(features)
        if d < 2:
            continue
        points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        for s, w in zip((points + 1) / 2, weights / 2, strict=True):
            factors = o * s + (z * (1 - s))[:, None]
            for a in range(d):
                rest = _without(np.delete(factors, a, axis=0))
                others = [b for b in range(d) if b != a]
                for k, b in enumerate(others):
                    out[:, features[a], features[b]] += 0.5 * value * w * (o[a] - z[a]) * (o[b] - z[b]) * rest[k]
    main = exact(t, x, m, column)
    at = np.arange(m + 1)
    out[:, at, at] = main - out.sum(axis=2)
    return out


def approximate(t: Tree, x: np.ndarray, m: int, column: int = 0) -> np.ndarray:
    """Changes of the mean value along each row's path."""
    if t.leaf.shape[1] > 1:
        raise ValueError("approximate contributions need scalar leaves")
    mean = mean_values(t, column)
    out = np.zeros((len(x), m + 1))
    out[:, m] = mean[0]
    at = np.zeros(len(x), int)
    left = {i: _follows(t, i, x) for i in range(t.n) if t.left[i] >= 0}
    for i in range(t.n):
        if t.left[i] < 0:
            continue
        here = at == i
        child = np.where(left[i], t.left[i], t.right[i])
        np.add.at(out, (np.flatnonzero(here), t.feature[i]), mean[child[here]] - mean[i])
        at[here] = child[here]
    return out
