"""Pairwise ranking gradients of many queries at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Least debiasing term that is divided by.
EPS = 1e-16
#: Pairs of queries that are compared at once; a query with more stands alone.
PAIRS = 1 << 19


def lambda_gradients(score: np.ndarray, label: np.ndarray, kind: str, params: dict, weight: float | np.ndarray = 1.0, bias: tuple[np.ndarray, np.ndarray] | None = None, key: int = 0, costs: np.ndarray | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each document of the queries that begin at ``starts`` (one query without it).

    kind: ndcg, map or pairwise. ``lambdarank_pair_method`` topk compares the best documents with all below
    them, mean compares each with as many others as asked, chosen by a hash of ``key``. Rows must be in row order; ties in
    score keep it. ``bias`` holds the position debiasing terms of clicked and unclicked places, a place being that of a row in row order;
    the losses that update them are added to the two rows of ``costs``. ``weight`` may have a number per query.
    """
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    if not n:
        return g, h
    starts = np.zeros(1, np.int64) if starts is None else starts
    sizes = np.diff(np.append(starts, n))
    weight = np.broadcast_to(np.asarray(weight, np.float64), len(starts))
    top = _top(sizes, params)
    pairs = np.cumsum(top * sizes)
    first = 0
    while first < len(starts):  # runs of queries with a bounded number of pairs
        past = max(first + 1, int(np.searchsorted(pairs, (pairs[first - 1] if first else 0) + PAIRS, side="right")))
        a, b = int(starts[first]), int(starts[past]) if past < len(starts) else n
        g[a:b], h[a:b] = _run(score[a:b], label[a:b], starts[first:past] - a, sizes[first:past], top[first:past], kind, params, weight[first:past], bias, key, costs[:, a:b] if costs is not None else None)
        first = past
    return g, h


def _top(sizes: np.ndarray, params: dict) -> np.ndarray:
    """Documents of each query that are compared with all below them."""
    per = params.get("lambdarank_num_pair_per_sample")
    return np.minimum(sizes, int(per) if per is not None else 32) if params.get("lambdarank_pair_method", "topk") == "topk" else sizes


def _run(score, label, starts, sizes, top, kind, params, weight, bias, key, costs) -> tuple[np.ndarray, np.ndarray]:
    n, method, per = len(score), params.get("lambdarank_pair_method", "topk"), params.get("lambdarank_num_pair_per_sample")
    g, h = np.zeros(n), np.zeros(n)
    normal, score_normal = bool(int(params.get("lambdarank_normalization", 1))), bool(int(params.get("lambdarank_score_normalization", 1)))
    query = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[query]
    order = np.lexsort((-score, query))
    if method == "topk":
        below = np.where(place < top[query], sizes[query] - 1 - place, 0)
        i = np.repeat(np.arange(n), below)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(below) - below, below)
    else:
        drawn = [_drawn(label[order[s : s + m]], int(per or 1), key) + s for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
        i, j = np.concatenate(drawn, axis=1)
    a, b = order[i], order[j]
    differ = label[a] != label[b]
    i, j, a, b = i[differ], j[differ], a[differ], b[differ]
    if not len(a):
        return g, h
    swap = label[a] < label[b]
    hi, lo = np.where(swap, b, a), np.where(swap, a, b)
    hi_at, lo_at = np.where(swap, j, i), np.where(swap, i, j)
    of = query[a]
    gap = (score[hi] - score[lo]).astype(np.float64)
    delta = _delta(kind, label, order, query, place, starts, sizes, top, hi, lo, hi_at, lo_at, of, params)
    if kind != "pairwise" and score_normal:
        spread = score[order[starts]] != score[order[starts + sizes - 1]]
        delta = np.where(spread[of], delta / (np.abs(gap) + 0.01), delta)
    p = 1 / (1 + np.exp(np.minimum(-gap, 88.7)) + 1e-16)
    lam = (p - 1) * delta
    hess = np.maximum(p * (1 - p), 1e-16) * delta * 2
    if bias is not None:
        k = len(bias[0])
        held = np.flatnonzero((place[hi] < k) & (place[lo] < k))
        plus, minus = bias[0][place[hi[held]]], bias[1][place[lo[held]]]
        if costs is not None:
            with np.errstate(divide="ignore"):
                loss = -np.log(1 - p[held]) * delta[held]
            for row, at, t in ((0, hi, minus), (1, lo, plus)):
                ok = t >= EPS
                np.add.at(costs[row], at[held][ok], loss[ok] / t[ok])
        ok = (plus >= EPS) & (minus >= EPS)
        t = np.ones(len(lam))
        t[held[ok]] = plus[ok] * minus[ok]
        lam, hess = lam / t, hess / t
    ends = np.concatenate((hi, lo))
    g, h = np.bincount(ends, np.concatenate((lam, -lam)), n), np.bincount(ends, np.concatenate((hess, hess)), n)
    if normal:
        total = -2 * np.bincount(of, lam, len(starts))
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(total > 0, np.log2(1 + total) / total, 1.0) if method == "topk" else np.full(len(starts), 1.0 / max(1, int(per or 1)))
        g, h = g * factor[query], h * factor[query]
    return g * weight[query], h * weight[query]


def _drawn(ranked: np.ndarray, per: int, key: int) -> np.ndarray:
    """Pairs of places of one query: each document with ``per`` of those with other labels."""
    rng = np.random.default_rng(key)
    lists = [(k, rng.choice(others, per)) for k in range(len(ranked)) if len(others := np.flatnonzero(ranked != ranked[k]))]
    i = np.repeat([k for k, _ in lists], per).astype(int)
    j = np.concatenate([x for _, x in lists]).astype(int) if lists else np.zeros(0, int)
    return np.stack((np.minimum(i, j), np.maximum(i, j)))


def _upto(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of each query, added up from its first row as if it stood alone: queries of like size are rows of a matrix."""
    out = np.empty(len(x))
    width = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(width):
        own = np.flatnonzero(width == k)
        at = starts[own, None] + np.arange(1 << k)
        held = np.arange(1 << k) < sizes[own, None]
        sums = np.cumsum(np.where(held, x[np.minimum(at, len(x) - 1)], 0.0), axis=1)
        out[at[held]] = sums[held]
    return out


def _delta(kind, label, order, query, place, starts, sizes, top, hi, lo, hi_at, lo_at, of, params):
    if kind == "pairwise":
        return np.ones(len(hi))
    if kind == "ndcg":
        rel = 2.0**label - 1 if int(params.get("ndcg_exp_gain", 1)) else label.astype(np.float64)
        discount = 1 / np.log2(np.arange(sizes.max()) + 2.0)
        best = np.where(place < top[query], rel[np.lexsort((-rel, query))] * discount[place], 0.0)
        ideal = np.bincount(query, best, len(starts))[of]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(ideal > 0, np.abs((rel[hi] - rel[lo]) * (discount[place[hi_at]] - discount[place[lo_at]])) / ideal, 0.0)
    ranked = label[order]
    hits = _upto(ranked, starts, sizes)
    share = _upto(ranked / (place + 1), starts, sizes)
    total = hits[starts + sizes - 1][of]
    up, down = np.minimum(hi_at, lo_at), np.maximum(hi_at, lo_at)
    better_up = hi_at < lo_at
    between = np.where(down - 1 > up, share[np.maximum(down - 1, 0)] - share[up], 0.0)
    gained = hits[down] / (place[down] + 1.0)
    lost = np.where(better_up, hits[up] / (place[up] + 1.0), (hits[up] + 1) / (place[up] + 1.0))
    change = np.where(better_up, gained - lost - between, lost + between - gained)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.abs(change) / total, 0.0)
