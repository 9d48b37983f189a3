"""Tree growth over a binned frame: rows stay where they are, one job per level sums histograms of all open nodes.

Each task walks its rows through the part of the tree grown so far, sums gradients by (node, feature, bin) in numpy and
emits its sums by span of features; spans are added up in as many steps as the tasks need and searched where they meet, and only the
best candidate of each span reaches the driver.

The exact method adds a second job per level: bins are stretches of values whose sums give each stretch what lies before it,
so that every stretch is sorted and searched in a task of its own, and its best cut alone reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.model import Tree
from boostlake.operators.cuts import Cuts, bins_matrix
from boostlake.operators.splits import NodeColumn, Split, Stretch, TreeParams, best_exact, best_split, node_gain, stretch, weight
from boostlake.session import FAN_IN, steps

#: Bins of a span of features, which one group of the shuffle adds up and searches.
BLOCK = 16384
#: Sums that a task holds at once; a level with more open nodes takes several jobs.
TASK_BYTES = 1 << 28
RT_EPS = 1e-6


@dataclass
class BinnedTree:
    """A tree with the last left bin of each numeric split."""

    tree: Tree
    last_left: dict[int, int]

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of a matrix of bins (-1 is missing)."""
        t = self.tree
        limit = np.zeros(t.n, np.int64)
        for k, v in self.last_left.items():
            limit[k] = v
        at = np.zeros(len(bins), np.int32)
        open_ = np.arange(len(bins)) if t.left[0] >= 0 else np.zeros(0, int)
        while len(open_):
            node = at[open_]
            b = bins[open_, t.feature[node]]
            left = np.where(b < 0, t.default_left[node], b <= limit[node])
            for k, cats in t.categories.items():
                here = (node == k) & (b >= 0)
                left[here] = ~np.isin(b[here], cats)
            at[open_] = np.where(left, t.left[node], t.right[node])
            open_ = open_[t.left[at[open_]] >= 0]
        return at


class ValueTree(BinnedTree):
    """A tree of the exact method: rows come with their values (NaN is missing)."""

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        return self.tree.leaves(bins)


def uniform(row_id: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row, the same wherever the row is."""
    with np.errstate(over="ignore"):
        x = row_id.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def _packed(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """Numbers of a column of byte strings, one string after another, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[[column.offset, column.offset + len(column)]] if len(column) else [0, 0]
    return np.frombuffer(memoryview(data)[at[0] : at[1]], kind) if at[1] > at[0] else np.zeros(0, kind)


def batch_arrays(batch: pa.RecordBatch, cuts: Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (values of the exact method), gradients and hessians (rows x outputs, through float32) of a batch with bins, g and h."""
    n = batch.num_rows
    bins = _packed(batch.column("bins"), cuts.kind).reshape(n, len(cuts.values))
    wide = lambda c: np.asarray(batch.column(c).flatten(), np.float64).reshape(n, -1).astype(np.float32).astype(np.float64)
    return bins, wide("g"), wide("h")


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of features (first, one past the last) of at most BLOCK bins together; a feature with more stands alone."""
    out, first, held = [], 0, 0
    for f, n in enumerate(sizes):
        if f > first and held + n > BLOCK:
            out.append((first, f))
            first, held = f, 0
        held += n
    return [*out, (first, len(sizes))]


def _sums(df: DataFrame, shared: Broadcast) -> DataFrame:
    """Sums of the wanted nodes of each tree by span of features, added up until few parts of each are left.

    ``df`` has row_id, bins, g and h; ``shared`` holds (trees, wanted, cuts, outputs, sample): tree k sums the outputs[k] of g and h of
    the nodes wanted[k], and ``sample`` maps (row_id, g, h) to the scale of each row. A task tells only of nodes that it has rows of.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted, cuts, outputs, sample = shared.value
        starts = _starts(cuts)
        total = int(starts[-1])
        sums: dict[tuple[int, int], np.ndarray] = {}
        whole: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            held, g, h = batch_arrays(batch, cuts)
            bins = bins_matrix(held, cuts) if cuts.exact else held
            if sample is not None:
                s = sample(np.asarray(batch.column("row_id")), g, h)[:, None]
                g, h = g * s, h * s
            place = bins.astype(np.int64) + starts[:-1]
            for k, ns in enumerate(wanted):
                if not ns:
                    continue
                node = trees[k].nodes_of(held)
                slot = np.full(trees[k].tree.n, -1)
                slot[ns] = np.arange(len(ns))
                rows = np.flatnonzero(slot[node] >= 0)
                if not len(rows):
                    continue
                own = slot[node[rows]]
                here = np.unique(own)
                slim = np.searchsorted(here, own)
                for i in here:
                    sums.setdefault((k, ns[i]), np.zeros((total, len(outputs[k]), 2)))
                    whole.setdefault((k, ns[i]), np.zeros((len(outputs[k]), 2)))
                ok = bins[rows] >= 0
                flat = (slim[:, None] * total + place[rows])[ok]
                for j, o in enumerate(outputs[k]):
                    for m, x in enumerate((g, h)):
                        v = x[rows, o]
                        got = np.bincount(flat, np.broadcast_to(v[:, None], ok.shape)[ok], len(here) * total).reshape(len(here), total)
                        part = np.bincount(slim, v, len(here))
                        for at, i in enumerate(here):
                            sums[k, ns[i]][:, j, m] += got[at]
                            whole[k, ns[i]][j, m] += part[at]
        pid = TaskContext.get().partitionId()
        for (k, n), x in sums.items():
            for at, (a, b) in enumerate(spans([len(v) for v in cuts.values])):
                yield _block(k, n, at, pid, x[starts[a] : starts[b]], whole[k, n])

    def add(t: pa.Table) -> pa.Table:
        first = lambda c: t.column(c)[0].as_py()
        return pa.Table.from_batches([_block(first("k"), first("node"), first("at"), int(np.asarray(t.column("pid")).min()), *_added(t))])

    schema = "k int, node int, at int, pid int, sums binary, whole binary"
    blocks = df.select("row_id", "bins", "g", "h").mapInArrow(local, schema)
    for level in range(1, steps(df) + 1):
        blocks = blocks.groupBy("k", "node", "at", F.expr(f"pid div {FAN_IN**level}")).applyInArrow(add, schema)
    return blocks


_BLOCKS = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("at", pa.int32()), ("pid", pa.int32()), ("sums", pa.binary()), ("whole", pa.binary())])


def _starts(cuts: Cuts) -> np.ndarray:
    """First bin of each feature among the bins of all, and their number."""
    return np.concatenate(([0], np.cumsum([len(v) for v in cuts.values]))).astype(np.int64)


def _block(k: int, n: int, at: int, pid: int, x: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": [k], "node": [n], "at": [at], "pid": [pid], "sums": [np.ascontiguousarray(x).tobytes()], "whole": [whole.tobytes()]}, schema=_BLOCKS)


def _added(t: pa.Table) -> list[np.ndarray]:
    """The sums of a span and of its node over all parts, in order of the parts."""
    order, out = np.argsort(np.asarray(t.column("pid")), kind="stable"), []
    for c in ("sums", "whole"):
        x = np.frombuffer(t.column(c)[int(order[0])].as_py()).copy()
        for i in order[1:].tolist():
            x += np.frombuffer(t.column(c)[i].as_py())
        out.append(x)
    return out


def histograms(df: DataFrame, trees: list[BinnedTree], wanted: list[list[int]], cuts: Cuts, outputs: list[list[int]], sample: Callable | None = None) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Sums of the wanted nodes on the driver, for the exact method: (tree, node) to (stretches x targets x 2, targets x 2)."""
    shared = df.sparkSession.sparkContext.broadcast((trees, wanted, cuts, outputs, sample))
    starts, runs = _starts(cuts), spans([len(v) for v in cuts.values])

    def add(t: pa.Table) -> pa.Table:
        first = lambda c: t.column(c)[0].as_py()
        return pa.Table.from_batches([_block(first("k"), first("node"), first("at"), 0, *_added(t))])

    out = {(k, n): (np.zeros((int(starts[-1]), len(outputs[k]), 2)), np.zeros((len(outputs[k]), 2))) for k, ns in enumerate(wanted) for n in ns}
    for r in _sums(df, shared).groupBy("k", "node", "at").applyInArrow(add, "k int, node int, at int, pid int, sums binary, whole binary").collect():
        hist, whole = out[r["k"], r["node"]]
        a, b = runs[r["at"]]
        hist[starts[a] : starts[b]] = np.frombuffer(r["sums"]).reshape(-1, *whole.shape)
        whole[:] = np.frombuffer(r["whole"]).reshape(whole.shape)
    shared.unpersist()
    return out


def _searcher(limits: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """The search of one span of features of one node; ``limits`` holds (cuts, parameters, limits by node)."""

    def search(t: pa.Table) -> pa.Table:
        cuts, p, nodes = limits.value
        k, n, at = (t.column(c)[0].as_py() for c in ("k", "node", "at"))
        sums, whole = _added(t)
        whole = whole.reshape(-1, 2)
        starts = _starts(cuts)
        a, b = spans([len(v) for v in cuts.values])[at]
        cells = sums.reshape(-1, *whole.shape)
        hist = [cells[starts[f] - starts[a] : starts[f + 1] - starts[a]] for f in range(a, b)]
        own = replace(p, monotone_constraints=p.monotone_constraints[a:b])
        s = best_split(hist, whole, cuts.values[a:b], cuts.categorical[a:b], own, nodes[k, n].allowed[a:b], nodes[k, n].bounds)
        row = {"k": k, "node": n, "at": at, "whole": whole.tobytes()}
        if s is not None:
            cats = None if s.categories is None else np.asarray(s.categories, np.int64).tolist()
            row |= {"gain": s.gain, "feature": a + s.feature, "cond": s.cond, "default_left": s.default_left, "children": np.stack((s.left, s.right)).tobytes(), "categories": cats}
        return pa.Table.from_pylist([row], schema=_CANDIDATES)

    return search


def splits(df: DataFrame, trees: list[BinnedTree], nodes: dict[tuple[int, int], NodeLimits], cuts: Cuts, p: TreeParams, outputs: list[list[int]], sample: Callable | None = None) -> dict[tuple[int, int], tuple[Split | None, np.ndarray]]:
    """The best split and the sums (targets x 2) of each (tree, node): a group of the shuffle adds up one span of features of
    one node and searches it, so that one candidate of each span reaches the driver.

    A job takes as many nodes as fit in TASK_BYTES of sums.
    """
    found: dict[tuple[int, int], tuple[Split | None, np.ndarray]] = {x: (None, np.zeros((len(outputs[x[0]]), 2))) for x in nodes}
    sc, bins = df.sparkSession.sparkContext, int(_starts(cuts)[-1])
    per = max(1, TASK_BYTES // (16 * max(bins, 1) * max(map(len, outputs))))
    names = list(nodes)
    for i in range(0, len(names), per):
        part = names[i : i + per]
        wanted = [[n for t, n in part if t == k] for k in range(len(trees))]
        shared = sc.broadcast((trees, wanted, cuts, outputs, sample))
        limits = sc.broadcast((cuts, p, {x: nodes[x] for x in part}))

        told = _sums(df, shared).groupBy("k", "node", "at").applyInArrow(_searcher(limits), "k int, node int, at int, whole binary, gain double, feature int, cond double, default_left boolean, children binary, categories array<long>")
        for r in sorted(told.collect(), key=lambda r: r["at"]):
            key = (r["k"], r["node"])
            best, whole = found[key][0], np.frombuffer(r["whole"]).reshape(-1, 2).copy()
            if r["gain"] is not None and r["gain"] > (best.gain if best else 0.0):
                left, right = np.frombuffer(r["children"]).reshape(2, *whole.shape).copy()
                best = Split(r["gain"], r["feature"], r["cond"], r["default_left"], left, right, None if r["categories"] is None else np.array(r["categories"], np.int64))
            found[key] = (best, whole)
        shared.unpersist()
        limits.unpersist()
    return found


_CANDIDATES = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("at", pa.int32()), ("whole", pa.binary()), ("gain", pa.float64()), ("feature", pa.int32()), ("cond", pa.float64()), ("default_left", pa.bool_()), ("children", pa.binary()), ("categories", pa.list_(pa.int64()))])


def exact_splits(df: DataFrame, trees: list[BinnedTree], columns: dict[tuple[int, int], dict[int, NodeColumn]], before: dict[tuple[int, int], np.ndarray], cuts: Cuts, p: TreeParams, outputs: list[list[int]], sample: Callable | None = None) -> dict[tuple[int, int], Split | None]:
    """The best exact split of each (tree, node) of ``columns``, which has the features that a node may use.

    ``before``: sums of the node's rows in the stretches before each one, stretches of all features one after another. Tasks
    sum up equal values of a batch; a group of the shuffle is one stretch of one feature in one node.
    """
    starts = np.concatenate(([0], np.cumsum([len(v) for v in cuts.values])))
    wanted = [sorted(n for t, n in columns if t == k) for k in range(len(trees))]
    shared = df.sparkSession.sparkContext.broadcast((trees, wanted, columns, before, starts, cuts, p, outputs, sample))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted, columns, _, _, cuts, _, outputs, sample = shared.value
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            x, g, h = batch_arrays(batch, cuts)
            bins = bins_matrix(x, cuts)
            if sample is not None:
                s = sample(np.asarray(batch.column("row_id")), g, h)[:, None]
                g, h = g * s, h * s
            for k, ns in enumerate(wanted):
                if not ns:
                    continue
                node, both = trees[k].nodes_of(x), np.stack((g[:, outputs[k]], h[:, outputs[k]]), axis=-1).reshape(len(x), -1)
                for f in range(x.shape[1]):
                    here = np.zeros(trees[k].tree.n, bool)
                    here[[n for n in ns if f in columns[k, n]]] = True
                    rows = np.flatnonzero(here[node] & (bins[:, f] >= 0))
                    if not len(rows):
                        continue
                    rows = rows[np.lexsort((x[rows, f], node[rows]))]
                    v, n = x[rows, f], node[rows]
                    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (n[1:] != n[:-1]))))
                    sums = np.add.reduceat(both[rows], at, axis=0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                    full = lambda c, n=len(at), t=np.int32: pa.array(np.full(n, c, t))
                    yield pa.RecordBatch.from_arrays([full(k), pa.array(n[at].astype(np.int32)), full(f), pa.array(bins[rows[at], f].astype(np.int32)), pa.array(v[at]), full(part, t=np.int64), lists], names=["k", "node", "feature", "bin", "value", "part", "sums"])
            part += 1

    def search(t: pa.Table) -> pa.Table:
        _, _, columns, before, starts, _, p, _, _ = shared.value
        k, n, f, b = (t.column(c)[0].as_py() for c in ("k", "node", "feature", "bin"))
        v, c = np.asarray(t.column("value"), np.float32), columns[k, n][f]
        order = np.lexsort((np.asarray(t.column("part")), v))
        v = v[order]
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        sums = np.add.reduceat(t.column("sums").combine_chunks().flatten().to_numpy().reshape(len(v), -1)[order], at, axis=0).reshape(len(at), *c.total.shape)
        seen = sums[..., 1].sum(axis=-1) > 0
        if not seen.any():
            return _STRETCHES.empty_table()
        s = stretch(v[at][seen], sums[seen], before[k, n][starts[f] + b], c, p)
        return pa.Table.from_pydict({"k": [k], "node": [n], "feature": [f], "bin": [b], "first": [s.first], "last": [s.last], "gains": [[s.down[0], s.up[0]]], "conds": [[s.down[1], s.up[1]]], "sums": [np.stack((s.upto, s.down[2], s.up[2])).tobytes()]}, schema=_STRETCHES)

    pieces = df.select("row_id", "bins", "g", "h").mapInArrow(local, "k int, node int, feature int, bin int, value float, part long, sums array<double>")
    parts: dict[tuple[int, int], dict[int, list[tuple[int, Stretch]]]] = {}
    for r in pieces.groupBy("k", "node", "feature", "bin").applyInArrow(search, "k int, node int, feature int, bin int, first float, last float, gains array<double>, conds array<double>, sums binary").collect():
        key = (r["k"], r["node"])
        upto, down, up = np.frombuffer(r["sums"]).reshape(3, *columns[key][r["feature"]].total.shape)
        s = Stretch(np.float32(r["first"]), np.float32(r["last"]), upto, (r["gains"][0], r["conds"][0], down), (r["gains"][1], r["conds"][1], up))
        parts.setdefault(key, {}).setdefault(r["feature"], []).append((r["bin"], s))
    shared.unpersist()
    ordered = lambda key: {f: (columns[key][f], [s for _, s in sorted(v, key=lambda x: x[0])]) for f, v in parts.get(key, {}).items()}
    return {key: best_exact(ordered(key), p) for key in columns}


_STRETCHES = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("first", pa.float32()), ("last", pa.float32()), ("gains", pa.list_(pa.float64())), ("conds", pa.list_(pa.float64())), ("sums", pa.binary())])


@dataclass
class NodeLimits:
    """Features that a node may use and the bounds of its weights."""

    allowed: np.ndarray
    bounds: tuple[float, float]


@dataclass
class _Open:
    node: int
    depth: int
    sums: np.ndarray
    bounds: list[tuple[float, float]]
    path: frozenset[int]
    split: Split | None = None


class ColumnSampler:
    """Features by tree, level and node; with weights by exponential keys."""

    def __init__(self, n: int, p: TreeParams, rng: np.random.Generator):
        self.n, self.p, self.rng = n, p, rng
        self.tree = self._draw(np.arange(n), p.colsample_bytree)
        self.levels: dict[int, np.ndarray] = {}

    def _draw(self, from_: np.ndarray, rate: float) -> np.ndarray:
        if rate >= 1:
            return from_
        k = max(1, int(rate * len(from_)))
        w = np.ones(len(from_)) if self.p.feature_weights is None else np.asarray(self.p.feature_weights, float)[from_]
        with np.errstate(divide="ignore"):
            keys = np.log(self.rng.random(len(from_))) / w
        return np.sort(from_[np.argsort(-keys, kind="stable")[:k]])

    def allowed(self, depth: int) -> np.ndarray:
        if depth not in self.levels:
            self.levels[depth] = self._draw(self.tree, self.p.colsample_bylevel)
        out = np.zeros(self.n, bool)
        out[self._draw(self.levels[depth], self.p.colsample_bynode)] = True
        return out


def interaction_mask(path: frozenset[int], sets: list[list[int]], n: int) -> np.ndarray:
    """Features that may follow a path: its own, and those of all sets that hold the whole path."""
    if not sets:
        return np.ones(n, bool)
    out = np.zeros(n, bool)
    out[list(path)] = True
    for s in sets:
        if path <= set(s):
            out[s] = True
    if not path:
        out[[f for s in sets for f in s]] = True
    return out


def grow(df: DataFrame, cuts: Cuts, p: TreeParams, outputs: list[list[int]], rng: np.random.Generator, sample: Callable | None = None, scale: float = 1.0) -> list[BinnedTree]:
    """Grow one tree per entry of ``outputs`` (the outputs of g and h that it fits; several make vector leaves)."""
    starts, m, eta = _starts(cuts), len(cuts.values), p.learning_rate * scale
    exact = cuts.exact
    trees = [(ValueTree if exact else BinnedTree)(Tree.root(len(o)), {}) for o in outputs]
    samplers = [ColumnSampler(m, p, rng) for _ in outputs]
    free = (-np.inf, np.inf)

    def evaluate(opened: list[tuple[int, _Open]]) -> None:
        """Set sums and best split of open nodes."""
        limits = {(k, x.node): NodeLimits(samplers[k].allowed(x.depth) & interaction_mask(x.path, p.interaction_constraints, m), x.bounds[0] if len(x.bounds) == 1 else free) for k, x in opened}
        if not exact:
            found = splits(df, trees, limits, cuts, p, outputs, sample)
            for k, x in opened:
                x.split, x.sums = found[k, x.node]
            return
        hists = histograms(df, trees, [[x.node for t, x in opened if t == k] for k in range(len(trees))], cuts, outputs, sample)
        columns, before = {}, {}
        for k, x in opened:
            allowed, (low, high) = limits[k, x.node].allowed, limits[k, x.node].bounds
            hist, x.sums = hists[k, x.node]
            parent, upto = float(node_gain(x.sums, p, low, high)), np.zeros_like(hist)
            columns[k, x.node] = {}
            for f in np.flatnonzero(allowed).tolist():
                own = np.cumsum(hist[starts[f] : starts[f + 1]], axis=0)
                upto[starts[f] + 1 : starts[f + 1]] = own[:-1]
                missing = not np.allclose(own[-1][:, 1], x.sums[:, 1], rtol=1e-7, atol=1e-9)
                sides = {"left": (True,), "right": (False,)}.get(p.default_direction, (True, False) if missing else (True,))
                columns[k, x.node][f] = NodeColumn(x.sums, own[-1], sides, parent, p.monotone_constraints[f] if f < len(p.monotone_constraints) else 0, low, high)
            before[k, x.node] = upto
        cut = exact_splits(df, trees, columns, before, cuts, p, outputs, sample)
        for k, x in opened:
            x.split = cut[k, x.node]

    def leaf(x: _Open) -> np.ndarray:
        return np.array([weight(x.sums[j, 0], x.sums[j, 1], p, *x.bounds[j]) for j in range(len(x.sums))])

    queues = [[_Open(0, 0, np.zeros((len(o), 2)), [free] * len(o), frozenset())] for o in outputs]
    evaluate([(k, queue[0]) for k, queue in enumerate(queues)])
    for k, (root,) in enumerate(queues):
        w = leaf(root)
        t = trees[k].tree
        t.leaf[0], t.base_weight[0], t.sum_hess[0] = w * eta, w[0], root.sums[:, 1].mean()
    leaves = [1] * len(trees)
    while True:
        made: list[tuple[int, _Open, _Open, _Open, bool]] = []
        for k, queue in enumerate(queues):
            ready = [x for x in queue if x.split is not None and x.split.gain > RT_EPS and x.split.gain >= p.min_split_loss and (not p.max_depth or x.depth < p.max_depth)]
            if p.grow_policy == "lossguide":
                ready = sorted(ready, key=lambda x: (-x.split.gain, x.node))[:1]
            elif ready:
                top = min(x.depth for x in ready)
                ready = sorted((x for x in ready if x.depth == top), key=lambda x: x.node)
            for x in ready:
                if p.max_leaves and leaves[k] >= p.max_leaves:
                    break
                queue.remove(x)
                leaves[k] += 1
                made.append(_split(trees[k], x, cuts, p, eta, exact, leaf))
                made[-1] = (k, *made[-1])
        if not made:
            break
        opened = [(k, c) for k, _, a, b, deeper in made if deeper for c in (a, b)]
        for k, c in opened:
            queues[k].append(c)
        if opened:
            evaluate(opened)
    return trees


def _split(bt: BinnedTree, x: _Open, cuts: Cuts, p: TreeParams, eta: float, exact: bool, leaf) -> tuple[_Open, _Open, _Open, bool]:
    s, t = x.split, bt.tree
    bounds = [list(x.bounds), list(x.bounds)]
    sign = p.monotone_constraints[s.feature] if s.feature < len(p.monotone_constraints) else 0
    kids = [_Open(-1, x.depth + 1, v, b, x.path | {s.feature}) for v, b in ((s.left, bounds[0]), (s.right, bounds[1]))]
    w = [leaf(c) for c in kids]
    if sign:
        for j in range(len(x.bounds)):
            mid, (low, high) = (w[0][j] + w[1][j]) / 2, x.bounds[j]
            bounds[0][j], bounds[1][j] = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid))
    held = weight(x.sums[0, 0], x.sums[0, 1], p, *x.bounds[0])
    a, b = t.expand(x.node, s.feature, np.float32(1e-45) if s.categories is not None else s.cond, s.default_left, s.gain, np.stack(w) * eta, (s.left[:, 1].mean(), s.right[:, 1].mean()), s.categories)
    t.base_weight[x.node] = held
    if exact:
        t.base_weight[[a, b]] = [w[0][0], w[1][0]]
    if s.categories is None and not exact:
        values = cuts.values[s.feature]
        bt.last_left[x.node] = int(np.searchsorted(values, np.float32(s.cond), side="right")) - 1
    kids[0].node, kids[1].node = a, b
    return x, kids[0], kids[1], not p.max_depth or x.depth + 1 < p.max_depth
