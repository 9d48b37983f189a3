"""Linear boosting: one job per round gathers the weighted Gram matrix, coordinate steps follow on the driver.

With A the sums of h x x' and b those of g x, a step d on feature j moves b by d times column j of A, just as updating
every row's gradient would, so a pass over all coordinates needs the rows once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.session import FAN_IN, steps


def margins(df: DataFrame, weights: np.ndarray, has_margin: bool = True) -> DataFrame:
    """The margin column plus x times the weights and the bias; missing features count nothing."""
    k = weights.shape[1]
    parts = []
    for j in range(k):
        w = F.array(*[F.lit(float(v)) for v in weights[:-1, j]])
        dot = F.aggregate(F.zip_with("x", w, lambda a, b: F.coalesce(a.cast("double"), F.lit(0.0)) * b), F.lit(0.0), lambda a, v: a + v)
        parts.append(F.col("margin")[j] + dot + float(weights[-1, j]))
    return df.withColumn("margin", F.array(*parts))


def moments(gh: DataFrame, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, m + 1, m + 1) sums of h z z', (k, m + 1) sums of g z, and the row count; z is x followed by 1."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((k, m + 1, m + 1)), np.zeros((k, m + 1)), 0
        for t in batches:
            x = t.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, m)
            z = np.hstack((np.nan_to_num(x, nan=0.0), np.ones((t.num_rows, 1))))
            g, h = (np.asarray(t.column(c).flatten(), np.float64).reshape(t.num_rows, k).astype(np.float32).astype(np.float64) for c in ("g", "h"))
            for j in range(k):
                live = h[:, j] >= 0
                a[j] += (z[live] * h[live, j : j + 1]).T @ z[live]
                b[j] += z[live].T @ g[live, j]
            n += t.num_rows
        yield pa.RecordBatch.from_pydict({"key": [0], "sums": [np.concatenate((a.ravel(), b.ravel(), [n])).tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"key": t.column("key")[:1], "sums": pa.array([np.sum([np.frombuffer(s) for s in sorted(t.column("sums").to_pylist())], axis=0).tobytes()], pa.binary())})

    parts = gh.select("x", "g", "h").mapInArrow(local, "key long, sums binary")
    for level in range(steps(gh), 0, -1):  # FAN_IN parts meet in a task, about
        parts = parts.withColumn("key", F.pmod(F.xxhash64("sums"), F.lit(FAN_IN**level))).groupBy("key").applyInArrow(add, "key long, sums binary")
    parts = parts.withColumn("key", F.lit(0).cast("long"))
    s = np.frombuffer(parts.groupBy("key").applyInArrow(add, "key long, sums binary").first()["sums"])
    size = k * (m + 1) ** 2
    return s[:size].reshape(k, m + 1, m + 1), s[size:-1].reshape(k, m + 1), s[-1]


def delta(g: float, h: float, w: float, alpha: float, lam: float) -> float:
    """Coordinate step under elastic-net penalties."""
    if h < 1e-5:
        return 0.0
    g2, h2 = g + lam * w, h + lam
    if w - g2 / h2 >= 0:
        return max(-(g2 + alpha) / h2, -w)
    return min(-(g2 - alpha) / h2, -w)


def step(gh: DataFrame, weights: np.ndarray, params: dict, rng: np.random.Generator) -> float:
    """One round of coordinate descent; changes ``weights`` and returns the largest change."""
    m, k = weights.shape[0] - 1, weights.shape[1]
    a, b, n = moments(gh, m, k)
    eta = float(params.get("learning_rate", 0.5))
    lam, alpha = float(params.get("reg_lambda", 0)), float(params.get("reg_alpha", 0))
    selector, top = params.get("feature_selector", "cyclic"), int(params.get("top_k", 0) or 0)
    if params.get("updater", "shotgun") == "shotgun" and selector not in ("cyclic", "shuffle"):
        raise ValueError("the shotgun updater takes the cyclic and shuffle selectors")
    # penalties grow with the rows
    lam, alpha = lam * n, alpha * n
    before = weights.copy()
    for j in range(k):
        A, g = a[j], b[j].copy()
        d = np.float32(-g[m] / A[m, m] * eta) if A[m, m] > 0 else np.float32(0)
        weights[m, j] += d
        g += d * A[m]
        for f in order(selector, top, g, A, weights[:, j], alpha, lam, m, rng):
            d = np.float32(eta * delta(g[f], A[f, f], float(weights[f, j]), alpha, lam))
            if d:
                weights[f, j] += d
                g += d * A[f]
    return float(np.abs(weights - before).max())


def order(selector: str, top: int, g: np.ndarray, A: np.ndarray, w: np.ndarray, alpha: float, lam: float, m: int, rng: np.random.Generator) -> Iterator[int]:
    """Features in the order a selector takes them; greedy looks at the gradients as they are then."""
    if selector == "cyclic":
        yield from range(m)
    elif selector == "shuffle":
        yield from rng.permutation(m).tolist()
    elif selector == "random":
        yield from rng.integers(0, m, m).tolist()
    elif selector == "thrifty":
        size = [abs(delta(g[f], A[f, f], float(w[f]), alpha, lam)) for f in range(m)]
        yield from np.argsort(-np.array(size), kind="stable")[: top or m].tolist()
    elif selector == "greedy":
        for _ in range(top or m):
            size = [abs(delta(g[f], A[f, f], float(w[f]), alpha, lam)) for f in range(m)]
            if max(size) <= 0:
                return
            yield int(np.argmax(size))
    else:
        raise ValueError(f"unknown feature selector {selector}")


def contributions(x: np.ndarray, weights: np.ndarray, base: float) -> np.ndarray:
    """(rows, groups, features + 1): x times weight, then bias plus base."""
    out = np.zeros((len(x), weights.shape[1], weights.shape[0]))
    out[:, :, :-1] = np.nan_to_num(x, nan=0.0)[:, None, :] * weights[:-1].T[None]
    out[:, :, -1] = weights[-1] + base
    return out
