"""Split search: on histogram tables by windows, and in numpy for the training loop."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlake.functions import scalar as S


@dataclass
class TreeParams:
    """Parameters of tree growth."""

    learning_rate: float = 0.3
    min_split_loss: float = 0.0
    max_depth: int = 6
    max_leaves: int = 0
    max_bin: int = 256
    grow_policy: str = "depthwise"
    max_cat_to_onehot: int = 2**32 - 1
    max_cat_threshold: int = 64
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    max_delta_step: float = 0.0
    subsample: float = 1.0
    sampling_method: str = "uniform"
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    refresh_leaf: bool = True
    default_direction: str = "learn"
    monotone_constraints: list[int] = field(default_factory=list)
    interaction_constraints: list[list[int]] = field(default_factory=list)
    feature_weights: list[float] | None = None


ALIASES = {"eta": "learning_rate", "gamma": "min_split_loss", "lambda": "reg_lambda", "alpha": "reg_alpha"}


@dataclass
class Split:
    """A candidate: gain, feature, cut (or the categories that go right), side of missing values, children's sums."""

    gain: float
    feature: int
    cond: float
    default_left: bool
    left: np.ndarray
    right: np.ndarray
    categories: np.ndarray | None = None


def weight(g: np.ndarray, h: np.ndarray, p: TreeParams, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """Best weights, within max_delta_step and the bounds of monotone constraints."""
    soft = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(h > 0, -soft / (h + p.reg_lambda), 0.0)
    if p.max_delta_step:
        w = np.clip(w, -p.max_delta_step, p.max_delta_step)
    return np.clip(w, low, high)


def gain_at(g: np.ndarray, h: np.ndarray, w: np.ndarray, p: TreeParams) -> np.ndarray:
    return np.where(h > 0, -(2 * g * w + (h + p.reg_lambda) * w * w + 2 * p.reg_alpha * np.abs(w)), 0.0)


def node_gain(sums: np.ndarray, p: TreeParams, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """Gain of nodes from sums of shape (..., targets, 2), over all targets."""
    g, h = sums[..., 0], sums[..., 1]
    return gain_at(g, h, weight(g, h, p, low, high), p).sum(axis=-1)


def _valid(left: np.ndarray, right: np.ndarray, p: TreeParams) -> np.ndarray:
    a, b = left[..., 1].mean(axis=-1), right[..., 1].mean(axis=-1)
    return (a > 0) & (b > 0) & (a >= p.min_child_weight) & (b >= p.min_child_weight)


def _scores(left: np.ndarray, right: np.ndarray, parent: float, p: TreeParams, sign: int, low: float, high: float) -> np.ndarray:
    gain = node_gain(left, p, low, high) + node_gain(right, p, low, high) - parent
    ok = _valid(left, right, p)
    if sign:
        wl, wr = (weight(x[..., 0].sum(-1), x[..., 1].sum(-1), p, low, high) for x in (left, right))
        ok &= wl <= wr if sign > 0 else wl >= wr
    return np.where(ok & np.isfinite(gain), gain.astype(np.float32), -np.inf)


def best_split(hist: list[np.ndarray], total: np.ndarray, cuts: list[np.ndarray], categorical: list[bool], p: TreeParams, allowed: np.ndarray | None = None, bounds: tuple[float, float] = (-np.inf, np.inf), dense: list[bool] | None = None) -> Split | None:
    """The best split of a node.

    hist[f]: (bins, targets, 2) sums of gradient and hessian; total: (targets, 2). Among equal gains the lower feature
    and the first candidate win.
    """
    best: Split | None = None
    low, high = bounds
    parent = float(node_gain(total, p, low, high))

    def offer(scores: np.ndarray, f: int, make) -> None:
        nonlocal best
        if len(scores) and scores.max() > (best.gain if best else 0.0):
            k = int(scores.argmax())
            best = make(k, float(scores[k]))

    for f, h in enumerate(hist):
        if allowed is not None and not allowed[f]:
            continue
        sign = p.monotone_constraints[f] if f < len(p.monotone_constraints) else 0
        upto = np.cumsum(h, axis=0)
        own = upto[-1] if len(h) else np.zeros_like(total)
        missing = not np.allclose(own[:, 1], total[:, 1], rtol=1e-7, atol=1e-9) if dense is None else not dense[f]
        if categorical[f]:
            if len(h) < p.max_cat_to_onehot:
                _onehot(h, total, own, missing, f, parent, p, low, high, offer)
            else:
                _partition(h, total, own, f, parent, p, low, high, offer)
            continue
        left = upto
        offer(_scores(left, total - left, parent, p, sign, low, high), f, lambda k, g, left=left, f=f: Split(g, f, float(cuts[f][k]), False, left[k], total - left[k]))
        if missing:
            right = np.concatenate((own[None], own[None] - upto))[:-1][::-1]  # from the last bin down
            names = np.concatenate(([np.nextafter(np.float32(-np.inf), np.float32(0))], cuts[f][:-1]))[::-1]
            offer(_scores(total - right, right, parent, p, sign, low, high), f, lambda k, g, right=right, names=names, f=f: Split(g, f, float(names[k]), True, total - right[k], right[k]))
    return best


def _onehot(h, total, own, missing, f, parent, p, low, high, offer) -> None:
    """One category goes right; missing values left, then right."""
    right = h
    offer(_scores(total - right, right, parent, p, 0, low, high), f, lambda k, g: Split(g, f, float("nan"), True, total - right[k], right[k], np.array([k])))
    if missing:
        lost = total - own
        right2 = h + lost
        offer(_scores(total - right2, right2, parent, p, 0, low, high), f, lambda k, g: Split(g, f, float("nan"), False, total - right2[k], right2[k], np.array([k])))


def _partition(h, total, own, f, parent, p, low, high, offer) -> None:
    """Categories in order of their weight; a prefix goes right, scanned from both ends."""
    g, hs = h[..., 0], h[..., 1]
    w = weight(g, hs, p)
    base = weight(total[:, 0], total[:, 1], p)
    key = w[:, 0] if h.shape[1] == 1 else (w * base).sum(axis=1)
    order = np.argsort(key, kind="stable")
    n = min(p.max_cat_threshold, len(order))
    for forward in (True, False):
        seq = order if forward else order[::-1]
        right = np.cumsum(h[seq], axis=0)[: n if forward else n - (n == len(order))]
        if not forward:
            right = total - (np.cumsum(h[seq], axis=0)[: len(right)])
            left = total - right
            sets = lambda k, seq=seq: np.sort(np.setdiff1d(np.arange(len(order)), seq[: k + 1]))
            offer(_scores(left, right, parent, p, 0, low, high), f, lambda k, g, left=left, right=right, sets=sets: Split(g, f, float("nan"), False, left[k], right[k], sets(k)))
        else:
            offer(_scores(total - right, right, parent, p, 0, low, high), f, lambda k, g, right=right, seq=seq: Split(g, f, float("nan"), True, total - right[k], right[k], np.sort(seq[: k + 1])))


def middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cuts between neighbouring float32 values: the midpoint, or the smaller value where that is the larger one."""
    m = ((a + b) * np.float32(0.5)).astype(np.float32)
    return np.where(m == b, a, m)


@dataclass
class Stretch:
    """What one stretch of a feature's values in a node tells: its least and largest value, the sums up to its end, and
    the best cut between two of its own values with missing values left (down) and right (up), each as gain, cut and sums
    up to it."""

    first: np.float32
    last: np.float32
    upto: np.ndarray
    down: tuple[float, float, np.ndarray]
    up: tuple[float, float, np.ndarray]


@dataclass
class NodeColumn:
    """A node and a feature: sums of the node and of its rows that have a value, the sides on which missing values are
    tried (True is left), gain of the node and its limits."""

    total: np.ndarray
    own: np.ndarray
    sides: tuple[bool, ...]
    parent: float
    sign: int
    low: float
    high: float

    def scores(self, upto: np.ndarray, p: TreeParams, down: bool) -> np.ndarray:
        left = self.total - (self.own - upto) if down else upto
        return _scores(left, self.total - left, self.parent, p, self.sign, self.low, self.high)

    def split(self, gain: float, f: int, cond: float, upto: np.ndarray, down: bool) -> Split:
        left = self.total - (self.own - upto) if down else upto
        return Split(gain, f, cond, down, left, self.total - left)


def stretch(values: np.ndarray, sums: np.ndarray, before: np.ndarray, c: NodeColumn, p: TreeParams) -> Stretch:
    """``values``: ascending and distinct, with their ``sums`` (values, targets, 2); ``before``: sums of the smaller ones."""
    upto = before + np.cumsum(sums, axis=0)
    none = (-np.inf, 0.0, before)
    down = up = none
    if len(values) > 1:
        cut = middle(values[:-1], values[1:])
        s = c.scores(upto[:-1], p, True)
        k = len(s) - 1 - int(s[::-1].argmax())  # from the largest value down
        down = (float(s[k]), float(cut[k]), upto[k])
        if False in c.sides:
            s = c.scores(upto[:-1], p, False)
            k = int(s.argmax())
            up = (float(s[k]), float(cut[k]), upto[k])
    return Stretch(values[0], values[-1], upto[-1], down, up)


def best_exact(columns: dict[int, tuple[NodeColumn, list[Stretch]]], p: TreeParams) -> Split | None:
    """The best split of a node between any two values that it holds, or beyond them.

    Cuts are tried from the largest value down; upwards too where values are missing. Among equal gains the lower feature
    and the first candidate win.
    """
    best: Split | None = None
    for f in sorted(columns):
        c, parts = columns[f]
        v0, v1 = parts[0].first, parts[-1].last
        ends = np.array([x.upto for x in parts[:-1]]).reshape(-1, *c.total.shape)
        cuts = middle(np.array([x.last for x in parts[:-1]], np.float32), np.array([x.first for x in parts[1:]], np.float32))
        for down in c.sides:
            beyond = np.float32(v0 - (abs(v0) + np.float32(1e-6))) if down else np.float32(v1 + (abs(v1) + np.float32(1e-6)))
            found = []
            for i, g in enumerate(c.scores(ends, p, down) if len(ends) else []):
                found += [parts[i].down if down else parts[i].up, (float(g), float(cuts[i]), ends[i])]
            found.append(parts[-1].down if down else parts[-1].up)
            edge = np.zeros_like(c.own) if down else c.own
            last = (float(c.scores(edge, p, down)), float(beyond), edge)
            for g, cond, upto in ([*found[::-1], last] if down else [*found, last]):
                if g > (best.gain if best else 0.0):
                    best = c.split(g, f, cond, upto, down)
    return best


# ---- the same search as DataFrame plans ----


def histogram(df: DataFrame, bins: dict[str, Column], node: Column, g: Column, h: Column) -> DataFrame:
    """(node, feature, bin, g, h, n) sums; ``bins`` maps feature names to bin columns, -1 is missing and left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), b.alias("bin")) for i, b in enumerate(bins.values())])
    rows = df.select(node.alias("node"), g.alias("g"), h.alias("h"), F.explode(pairs).alias("p")).select("node", "p.feature", "p.bin", "g", "h")
    return rows.where("bin >= 0").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def scan(hist: DataFrame, totals: DataFrame, p: TreeParams = TreeParams(), monotone: int = 0) -> DataFrame:
    """Candidates (node, feature, bin, default_left, gl, hl, gr, hr, gain, valid) of numeric splits after each bin.

    ``totals`` has (node, tg, th), one row per open node. Missing values go right in the upward scan and left in
    the downward one; a cut lies after its bin.
    """
    by = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    run = hist.join(F.broadcast(totals), "node").withColumn("cg", F.sum("g").over(by)).withColumn("ch", F.sum("h").over(by)).withColumn("sg", F.sum("g").over(whole)).withColumn("sh", F.sum("h").over(whole))
    up = run.select("node", "feature", "bin", "tg", "th", F.lit(False).alias("default_left"), F.col("cg").alias("gl"), F.col("ch").alias("hl"))
    down = run.where(F.abs(F.col("sh") - F.col("th")) > 1e-9).select("node", "feature", "bin", "tg", "th", F.lit(True).alias("default_left"), (F.col("cg") + F.col("tg") - F.col("sg")).alias("gl"), (F.col("ch") + F.col("th") - F.col("sh")).alias("hl"))
    both = up.unionByName(down).withColumn("gr", F.col("tg") - F.col("gl")).withColumn("hr", F.col("th") - F.col("hl"))
    return _scored(both, p, monotone)


def _scored(both: DataFrame, p: TreeParams, monotone: int = 0) -> DataFrame:
    gain = lambda g, h: S.gain(F.col(g), F.col(h), p.reg_lambda, p.reg_alpha, p.max_delta_step)
    ok = (F.col("hl") > 0) & (F.col("hr") > 1e-9) & (F.col("hl") >= p.min_child_weight) & (F.col("hr") >= p.min_child_weight)
    if monotone:
        wl, wr = (S.leaf_weight(F.col(a), F.col(b), p.reg_lambda, p.reg_alpha, p.max_delta_step) for a, b in (("gl", "hl"), ("gr", "hr")))
        ok = ok & (wl <= wr if monotone > 0 else wl >= wr)
    return both.withColumn("gain", gain("gl", "hl") + gain("gr", "hr") - gain("tg", "th")).withColumn("valid", ok)


def onehot_scan(hist: DataFrame, totals: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """Candidates that send one category right."""
    rows = hist.join(F.broadcast(totals), "node").withColumn("default_left", F.lit(True)).withColumn("gr", F.col("g")).withColumn("hr", F.col("h"))
    rows = rows.withColumn("gl", F.col("tg") - F.col("g")).withColumn("hl", F.col("th") - F.col("h"))
    return _scored(rows.select("node", "feature", "bin", "tg", "th", "default_left", "gl", "hl", "gr", "hr"), p)


def category_scan(hist: DataFrame, totals: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """Candidates that send the first categories, in order of weight, right."""
    rows = hist.withColumn("w", S.leaf_weight(F.col("g"), F.col("h"), p.reg_lambda, p.reg_alpha))
    by = Window.partitionBy("node", "feature").orderBy("w", "bin").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(F.broadcast(totals), "node").withColumn("place", F.row_number().over(Window.partitionBy("node", "feature").orderBy("w", "bin"))).withColumn("gr", F.sum("g").over(by)).withColumn("hr", F.sum("h").over(by))
    run = run.where(F.col("place") <= p.max_cat_threshold).withColumn("default_left", F.lit(True)).withColumn("gl", F.col("tg") - F.col("gr")).withColumn("hl", F.col("th") - F.col("hr"))
    return _scored(run.select("node", "feature", "bin", "tg", "th", "default_left", "gl", "hl", "gr", "hr"), p)


def best(candidates: DataFrame) -> DataFrame:
    """The valid candidate with the largest gain per node; the lower feature, then the upward scan, then the lower bin win ties."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round("gain", 9)), "feature", "default_left", "bin"))
    return candidates.where("valid").withColumn("rank", rank).where("rank = 1").drop("rank")


def subtract(parent: DataFrame, small: DataFrame) -> DataFrame:
    """Histogram of the other child: the parent's sums less the small child's."""
    s = small.select("feature", "bin", F.col("g").alias("sg"), F.col("h").alias("sh"), F.col("n").alias("sn"))
    j = parent.join(s, ["feature", "bin"], "left")
    return j.select("feature", "bin", (F.col("g") - F.coalesce("sg", F.lit(0.0))).alias("g"), (F.col("h") - F.coalesce("sh", F.lit(0.0))).alias("h"), (F.col("n") - F.coalesce("sn", F.lit(0))).alias("n"))
