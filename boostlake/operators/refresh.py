"""Existing trees on new data: statistics of all nodes on each row's path, refreshed leaves, pruned splits."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.model import Model
from boostlake.operators.splits import TreeParams, gain_at, weight


def node_stats(model: Model, df: DataFrame) -> DataFrame:
    """(tree, node, g, h): sums of gradient and hessian over the rows that pass each node. ``df`` has x, g and h (arrays)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = [np.zeros((t.n, 2)) for t in own.trees]
        for b in batches:
            n = b.num_rows
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)
            g, h = (np.asarray(b.column(c).flatten(), np.float64).reshape(n, -1) for c in ("g", "h"))
            for i, t in enumerate(own.trees):
                k = own.tree_info[i]
                leaf = t.leaves(x)
                for j, v in enumerate((g[:, k], h[:, k])):
                    sums[i][:, j] += np.bincount(leaf, v, t.n)
        for i, t in enumerate(own.trees):
            for node in range(t.n - 1, 0, -1):
                sums[i][t.parent[node]] += sums[i][node]
            yield pa.RecordBatch.from_pydict({"tree": pa.array([i] * t.n, pa.int32()), "node": pa.array(range(t.n), pa.int32()), "g": sums[i][:, 0], "h": sums[i][:, 1]})

    return df.select("x", "g", "h").mapInArrow(run, "tree int, node int, g double, h double").groupBy("tree", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


@dataclass
class NodeStats:
    """Hessians, weights and gains of the nodes of a tree in double, which the float32 of a model would round off."""

    hess: np.ndarray
    weight: np.ndarray
    gain: np.ndarray


def refreshed(model: Model, df: DataFrame, p: TreeParams | None = None) -> list[NodeStats]:
    """Statistics of every tree's nodes from ``df``; the gain of a leaf is 0."""
    p = p or TreeParams()
    sums = [np.zeros((t.n, 2)) for t in model.trees]
    for r in node_stats(model, df).collect():  # one row per node
        sums[r["tree"]][r["node"]] = r["g"], r["h"]
    out = []
    for t, x in zip(model.trees, sums, strict=True):
        w = weight(x[:, 0], x[:, 1], p)
        own, gain, inner = gain_at(x[:, 0], x[:, 1], w, p), np.zeros(t.n), np.flatnonzero(t.left >= 0)
        gain[inner] = own[t.left[inner]] + own[t.right[inner]] - own[inner]
        out.append(NodeStats(x[:, 1], w, gain))
    return out


def refresh(model: Model, df: DataFrame, p: TreeParams | None = None) -> Model:
    """The model with weights, hessians and gains from ``df``; leaves too if refresh_leaf."""
    p = p or TreeParams()
    out = copy.deepcopy(model)
    for t, s in zip(out.trees, refreshed(model, df, p), strict=True):
        t.sum_hess[:], t.base_weight[:], t.loss_chg[:] = s.hess, s.weight, s.gain
        if p.refresh_leaf:
            t.leaf[t.left < 0, 0] = s.weight[t.left < 0] * p.learning_rate
    return out


def prune(model: Model, p: TreeParams) -> Model:
    """The model without splits whose gain is under min_split_loss or that lie deeper than max_depth, from the bottom up."""
    out = copy.deepcopy(model)
    for t in out.trees:
        while True:
            depth = t.depths()
            bad = [i for i in range(t.n) if t.left[i] >= 0 and t.left[t.left[i]] < 0 and t.left[t.right[i]] < 0 and (t.loss_chg[i] < p.min_split_loss or (p.max_depth and depth[i] + 1 > p.max_depth))]
            if not bad:
                break
            i = max(bad)
            t.collapse(i, np.full(t.leaf.shape[1], p.learning_rate * t.base_weight[i], np.float32))
    return out
