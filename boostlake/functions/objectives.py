"""Objectives: gradients, hessians, intercepts and transformations as DataFrame expressions.

``gradient`` adds the arrays g and h, one entry per output, to a frame with ``margin`` (array of double), ``label`` (number, or
array for several targets), and where used ``weight``, ``qid``, ``lower``, ``upper`` and ``row_id``. Aggregates that an
objective needs first are fixed-size and are computed before the row expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlake.functions import scalar as S
from boostlake.functions.ranking import EPS, lambda_gradients

#: Rows of a batch of ranking gradients.
CHUNK = 10_000
FLT_EPS, FLT_MIN, FLT_MAX = 1.1920929e-07, 1.17549435e-38, 3.4028235e38


@dataclass(frozen=True)
class Frame:
    """Names of the special columns; None where a frame has none."""

    label: str = "label"
    margin: str = "margin"
    weight: str | None = None
    qid: str | None = None
    lower: str = "label_lower_bound"
    upper: str = "label_upper_bound"
    row_id: str = "row_id"

    def w(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else S.lit(1)


@dataclass
class Objective:
    """An objective and its parameters."""

    name: str
    metric: str
    params: dict = field(default_factory=dict)

    def outputs(self, targets: int = 1) -> int:
        return targets

    def _labels(self, f: Frame, targets: int) -> list[Column]:
        return [F.col(f.label).cast("double")] if targets == 1 else [F.col(f.label)[i].cast("double") for i in range(targets)]

    def gradient(self, df: DataFrame, f: Frame = Frame(), targets: int = 1) -> DataFrame:
        pairs = self.pairs([F.col(f.margin)[i] for i in range(self.outputs(targets))], self._labels(f, targets), f.w())
        return df.withColumn("g", F.array(*[p[0] for p in pairs])).withColumn("h", F.array(*[p[1] for p in pairs]))

    def settle(self, df: DataFrame) -> DataFrame:
        """The result of ``gradient``, after what the next round needs of it was taken."""
        return df

    def pairs(self, s: list[Column], y: list[Column], w: Column) -> list[tuple[Column, Column]]:
        return [self.pair(a, b, w) for a, b in zip(s, y, strict=True)]

    def pair(self, s: Column, y: Column, w: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def transform(self, s: list[Column]) -> list[Column]:
        return s

    def eval_transform(self, s: list[Column]) -> list[Column]:
        return self.transform(s)

    def to_margin(self, base: float) -> float:
        return base

    def valid(self, y: Column) -> Column | None:
        """The predicate that labels must meet, if any."""
        return None

    def intercept(self, df: DataFrame, f: Frame = Frame(), targets: int = 1) -> list[float]:
        """Base scores of the outputs, before ``to_margin``."""
        r = df.agg(*[(F.sum(y * f.w()) / F.sum(f.w())).alias(f"m{i}") for i, y in enumerate(self._labels(f, targets))]).first()
        return [float(x) for x in r]


class SquaredError(Objective):
    def pair(self, s, y, w):
        return (s - y) * w, w


class Logistic(Objective):
    def _w(self, y, w):
        p = float(self.params.get("scale_pos_weight", 1))
        return w if p == 1 else F.when(y == 1, w * p).otherwise(w)

    def pair(self, s, y, w):
        p, w = S.sigmoid(s), self._w(y, w)
        return (p - y) * w, F.greatest(p * (1.0 - p), S.lit(1e-16)) * w

    def transform(self, s):
        return [S.sigmoid(x) for x in s]

    def to_margin(self, base):
        held = min(max(base, 1e-6), 1 - 1e-6)
        return -math.log(1 / held - 1)

    def valid(self, y):
        return (y >= 0) & (y <= 1)

    def intercept(self, df, f=Frame(), targets=1):
        if float(self.params.get("scale_pos_weight", 1)) == 1:
            return super().intercept(df, f, targets)
        r = df.agg(*[(F.sum(y * self._w(y, f.w())) / F.greatest(F.sum(self._w(y, f.w())), S.lit(1e-6))).alias(f"m{i}") for i, y in enumerate(self._labels(f, targets))]).first()
        return [float(x) for x in r]


class LogitRaw(Logistic):
    def transform(self, s):
        return s

    def to_margin(self, base):
        return base

    def intercept(self, df, f=Frame(), targets=1):
        return [Logistic.to_margin(self, x) for x in super().intercept(df, f, targets)]


class PseudoHuber(Objective):
    def pair(self, s, y, w):
        d = float(self.params.get("huber_slope", 1))
        z = s - y
        h = abs(d) / F.hypot(S.lit(d), z)
        return z * h * w, h * w

    def intercept(self, df, f=Frame(), targets=1):
        start = df.withColumn(f.margin, F.array(*[S.lit(0)] * targets))
        return [float(x) for x in stump(self.gradient(start, f, targets), targets).first()]


class SquaredLogError(Objective):
    def pair(self, s, y, w):
        s = F.greatest(s, S.lit(-1 + 1e-6))
        d = F.log1p(s) - F.log1p(y)
        return d / (s + 1.0) * w, F.greatest((1.0 - d) / F.pow(s + 1.0, S.lit(2)), S.lit(1e-6)) * w

    def valid(self, y):
        return y > -1

    def intercept(self, df, f=Frame(), targets=1):
        r = df.agg(*[F.expm1(F.sum(F.log1p(y) * f.w()) / F.sum(f.w())).alias(f"m{i}") for i, y in enumerate(self._labels(f, targets))]).first()
        return [float(x) for x in r]


class _LogLink(Objective):
    def transform(self, s):
        return [F.exp(x) for x in s]

    def to_margin(self, base):
        return math.log(base)


class Poisson(_LogLink):
    def pair(self, s, y, w):
        m = F.exp(s)
        return (m - y) * w, (2.0 * m + y) * w / 3.0

    def valid(self, y):
        return y >= 0


class Gamma(_LogLink):
    def pair(self, s, y, w):
        r = y / F.exp(s)
        return (1.0 - r) * w, (2.0 * r + 1.0) / 3.0 * w

    def valid(self, y):
        return y > 0


class Tweedie(_LogLink):
    def __init__(self, name: str, metric: str, params: dict):
        super().__init__(name, f"tweedie-nloglik@{float(params.get('tweedie_variance_power', 1.5)):g}", params)

    def pair(self, s, y, w):
        p = float(self.params.get("tweedie_variance_power", 1.5))
        a, b = y * F.exp((1 - p) * s), F.exp((2 - p) * s)
        return (b - a) * w, (p * a + (3 - p) * b) * w / 3.0

    def valid(self, y):
        return y >= 0


def root_scale(df: DataFrame, residuals: list[Column], w: Column) -> list[float]:
    """Per output: the square of the weighted mean of root absolute residuals."""
    r = df.agg(*[F.pow(F.sum(w * F.sqrt(F.abs(x))) / F.sum(w), S.lit(2)).alias(f"c{i}") for i, x in enumerate(residuals)]).first()
    return [float(x or 0) for x in r]


def weighted_quantile(df: DataFrame, y: Column, w: Column, alpha: float) -> float:
    """First value whose cumulated weight reaches alpha of the whole; values are summed up before they are ordered."""
    sums = df.where(w > 0).groupBy(y.alias("v")).agg(F.sum(w).alias("w"))
    ordered = sums.withColumn("c", F.sum("w").over(Window.orderBy("v"))).withColumn("total", F.sum("w").over(Window.partitionBy()))
    if alpha >= 1:
        r = sums.agg(F.max("v")).first()[0]
    else:
        r = ordered.where(F.col("c") >= alpha * F.col("total")).agg(F.min("v")).first()[0]
    return 0.0 if r is None else float(r)


class AbsoluteError(Objective):
    def gradient(self, df, f=Frame(), targets=1):
        r = [F.col(f.margin)[i] - y for i, y in enumerate(self._labels(f, targets))]
        c, w = root_scale(df, r, f.w()), f.w()
        k = []
        for x, scale in zip(r, c, strict=True):
            n = F.hypot(S.lit(scale), x)
            k.append(F.when(n == 0, S.lit(1)).otherwise(scale / n))
        return df.withColumn("g", F.array(*[w * x * y for x, y in zip(r, k, strict=True)])).withColumn("h", F.array(*[w * y for y in k]))

    def intercept(self, df, f=Frame(), targets=1):
        return [weighted_quantile(df, y, f.w(), 0.5) for y in self._labels(f, targets)]


class Hinge(Objective):
    def pair(self, s, y, w):
        t = 2.0 * y - 1.0
        inside = s * t < 1
        return F.when(inside, -t * w).otherwise(S.lit(0)), F.when(inside, w).otherwise(S.lit(FLT_MIN))

    def transform(self, s):
        return [F.when(x > 0, S.lit(1)).otherwise(S.lit(0)) for x in s]

    def valid(self, y):
        return y.isin(0.0, 1.0)

    def intercept(self, df, f=Frame(), targets=1):
        return [1.0 if m > 0.5 else -1.0 if m < 0.5 else 0.0 for m in super().intercept(df, f, targets)]


class Normal(Objective):
    """Two outputs: mean and log variance."""

    def outputs(self, targets=1):
        return 2

    def pairs(self, s, y, w):
        m, v = s
        r = m - y[0]
        p = F.exp(F.least(F.greatest(-v, S.lit(-87)), S.lit(87)))
        t = (r * r + FLT_EPS) * p
        return [(w * r * p, w * p), (w * (1.0 - t) / 2.0, w * (1.0 + 2.0 * t) / 6.0)]

    def intercept(self, df, f=Frame(), targets=1):
        y, w = F.col(f.label).cast("double"), f.w()
        r = df.agg((F.sum(y * w) / F.sum(w)).alias("m"), (F.sum(y * y * w) / F.sum(w)).alias("q")).first()
        return [float(r["m"]), math.log(max(r["q"] - r["m"] ** 2, 0) + FLT_EPS)]


class Quantile(Objective):
    @property
    def alphas(self) -> list[float]:
        a = self.params.get("quantile_alpha", [0.5])
        return [float(x) for x in (a if isinstance(a, (list, tuple)) else [a])]

    def outputs(self, targets=1):
        return len(self.alphas)

    def gradient(self, df, f=Frame(), targets=1):
        y, w = F.col(f.label).cast("double"), f.w()
        r = [F.col(f.margin)[i] - y for i in range(len(self.alphas))]
        g, h = [], []
        for x, c, a in zip(r, root_scale(df, r, w), self.alphas, strict=True):
            if c <= 0:
                g.append(S.lit(0)), h.append(S.lit(0))
                continue
            z = x / (0.04 * c)
            ratio = F.when(z == 0, S.lit(1)).otherwise(F.greatest(F.tanh(z) / z, S.lit(3e-4)))
            g.append(w * 0.5 * c * (F.tanh(z) + (1 - 2 * a)))
            h.append(w * ratio * (0.5 / 0.04))
        return df.withColumn("g", F.array(*g)).withColumn("h", F.array(*h))

    def transform(self, s):
        if len(s) == 1:
            return s
        a = F.array_sort(F.array(*s))
        return [a[i] for i in range(len(s))]

    def intercept(self, df, f=Frame(), targets=1):
        return [weighted_quantile(df, F.col(f.label).cast("double"), f.w(), a) for a in self.alphas]


class Expectile(Objective):
    """Outputs are a base and positive steps, so that expectiles can't cross."""

    @property
    def alphas(self) -> list[float]:
        a = self.params.get("expectile_alpha", [0.5])
        return [float(x) for x in (a if isinstance(a, (list, tuple)) else [a])]

    def outputs(self, targets=1):
        return len(self.alphas)

    def transform(self, s):
        out = [s[0]]
        for x in s[1:]:
            out.append(out[-1] + 1e-6 + S.softplus(x))
        return out

    def pairs(self, s, y, w):
        d = [p - y[0] for p in self.transform(s)]
        omega = [F.when(x >= 0, S.lit(1 - a)).otherwise(S.lit(a)) for x, a in zip(d, self.alphas, strict=True)]
        out = []
        for j in range(len(s)):
            scale = S.lit(1) if j == 0 else S.sigmoid(s[j])
            gs, hs = [omega[k] * d[k] * w for k in range(j, len(s))], [omega[k] * w for k in range(j, len(s))]
            out.append((scale * sum(gs[1:], gs[0]), scale * scale * sum(hs[1:], hs[0])))
        return out

    def intercept(self, df, f=Frame(), targets=1):
        y, w = F.col(f.label).cast("double"), f.w()
        mean = float(df.agg(F.sum(y * w) / F.sum(w)).first()[0])
        d = mean - y
        om = [F.when(d >= 0, S.lit(1 - a)).otherwise(S.lit(a)) * w for a in self.alphas]
        r = df.agg(*[(-F.sum(o * d) / F.greatest(F.sum(o), S.lit(1e-6))).alias(f"e{i}") for i, o in enumerate(om)]).first()
        values = np.maximum.accumulate([mean + float(x) for x in r])
        steps = np.maximum(np.diff(values) - 1e-6, 1e-6)
        return [float(values[0]), *(float(x + math.log(-math.expm1(-x))) for x in steps)]


class Softmax(Objective):
    def outputs(self, targets=1):
        return int(self.params["num_class"])

    def pairs(self, s, y, w):
        out = []
        for k, p in enumerate(S.softmax(s)):
            g = p - F.when(y[0] == k, S.lit(1)).otherwise(S.lit(0))
            out.append((g * w, F.greatest(F.abs(g) * w, S.lit(1e-16))))
        return out

    def transform(self, s):
        return [S.argmax(s).cast("double")] if self.name == "multi:softmax" else S.softmax(s)

    def eval_transform(self, s):
        return S.softmax(s)

    def valid(self, y):
        return (y >= 0) & (y < self.outputs()) & (y == F.floor(y))

    def intercept(self, df, f=Frame(), targets=1):
        w = f.w()
        found = {int(r[0]): float(r[1]) for r in df.groupBy(F.col(f.label).cast("int")).agg(F.sum(w)).collect()}  # a row per class
        total = sum(found.values())
        logs = [math.log(found.get(k, 0) / total + 1e-6) for k in range(self.outputs())]
        return [x - sum(logs) / len(logs) for x in logs]


class Aft(Objective):
    # Bounds of the gradient and the hessian.
    G, H_LOW, H_HIGH, NEAR = 15.0, 1e-16, 15.0, 1e-12

    def gradient(self, df, f=Frame(), targets=1):
        dist, sigma = self.params.get("aft_loss_distribution", "normal"), float(self.params.get("aft_loss_distribution_scale", 1))
        lo, hi, s, w = F.col(f.lower).cast("double"), F.col(f.upper).cast("double"), F.col(f.margin)[0], f.w()
        right, left, exact = hi == float("inf"), lo <= 0, lo == hi
        zu, zl = (F.log(hi) - s) / sigma, (F.log(lo) - s) / sigma
        u, v = S.aft_parts(F.when(right | exact, S.lit(0)).otherwise(zu), dist), S.aft_parts(F.when(left, S.lit(0)).otherwise(zl), dist)
        up = {k: F.when(right, S.lit(1 if k == "cdf" else 0)).otherwise(u[k]) for k in u}
        low = {k: F.when(left, S.lit(0)).otherwise(v[k]) for k in v}
        mass, slope = up["cdf"] - low["cdf"], up["pdf"] - low["pdf"]
        positive = F.when(exact, zl > 0).otherwise((~right & (zu > 0)) | (~left & (zl > 0)))
        gn, gd = F.when(exact, v["grad"]).otherwise(slope), F.when(exact, sigma * v["pdf"]).otherwise(sigma * mass)
        hn = F.when(exact, v["grad"] * v["grad"] - v["pdf"] * v["hess"]).otherwise(slope * slope - mass * (up["grad"] - low["grad"]))
        hd = F.when(exact, sigma**2 * v["pdf"] * v["pdf"]).otherwise(sigma**2 * mass * mass)
        gp, gm, h_at = {"normal": (-self.G, self.G, 1 / sigma**2), "logistic": (-1 / sigma, 1 / sigma, self.H_LOW), "extreme": (-self.G, 1 / sigma, None)}[dist]
        kept_left, kept_right = left & ~exact & ~right, right & ~exact
        g_limit = F.when(kept_right, F.when(positive, S.lit(gp)).otherwise(S.lit(0))).when(kept_left, F.when(positive, S.lit(0)).otherwise(S.lit(gm))).otherwise(F.when(positive, S.lit(gp)).otherwise(S.lit(gm)))
        if dist == "extreme":
            h_limit = F.when(kept_left, S.lit(self.H_LOW)).otherwise(F.when(positive, S.lit(self.H_HIGH)).otherwise(S.lit(self.H_LOW)))
        else:
            h_limit = F.when(kept_right, F.when(positive, S.lit(h_at)).otherwise(S.lit(self.H_LOW))).when(kept_left, F.when(positive, S.lit(self.H_LOW)).otherwise(S.lit(h_at))).otherwise(S.lit(h_at))
        ratio = lambda n, d, limit: F.when((d < self.NEAR) & ((d == 0) | F.isnan(n / F.nullif(d, S.lit(0))) | (F.abs(n / F.nullif(d, S.lit(0))) == float("inf"))), limit).otherwise(n / F.nullif(d, S.lit(0)))
        clip = lambda x, a, b: F.least(F.greatest(x, S.lit(a)), S.lit(b))
        return df.withColumn("g", F.array(clip(ratio(gn, gd, g_limit), -self.G, self.G) * w)).withColumn("h", F.array(clip(ratio(hn, hd, h_limit), self.H_LOW, self.H_HIGH) * w))

    def transform(self, s):
        return [F.exp(x) for x in s]

    def eval_transform(self, s):
        return s

    def to_margin(self, base):
        return math.log(base)

    def intercept(self, df, f=Frame(), targets=1):
        return [0.5]


def cox_risk(df: DataFrame, f: Frame = Frame()) -> DataFrame:
    """Adds e (exponential of the margin), risk (sum of e over rows whose time isn't earlier), r and t: sums of 1 / risk
    and its square over the events up to the row, in order of time and row_id. Sums are taken per distinct time
    before they are cumulated."""
    y = F.col(f.label).cast("double")
    df = df.withColumn("e", F.exp(F.col(f.margin)[0])).withColumn("time", F.abs(y)).withColumn("event", F.when(y > 0, S.lit(1)).otherwise(S.lit(0)))
    times = df.groupBy("time").agg(F.sum("e").alias("e"), F.sum("event").alias("events"))
    later = times.withColumn("risk", F.sum("e").over(Window.orderBy(F.desc("time"))))
    before = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    upto = later.withColumn("r0", F.coalesce(F.sum(F.col("events") / F.col("risk")).over(before), S.lit(0))).withColumn("t0", F.coalesce(F.sum(F.col("events") / (F.col("risk") * F.col("risk"))).over(before), S.lit(0)))
    in_tie = F.sum("event").over(Window.partitionBy("time").orderBy(f.row_id).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("in_tie", in_tie).join(upto.select("time", "risk", "r0", "t0"), "time")
    return out.withColumn("r", F.col("r0") + F.col("in_tie") / F.col("risk")).withColumn("t", F.col("t0") + F.col("in_tie") / (F.col("risk") * F.col("risk"))).drop("in_tie", "r0", "t0")


class Cox(_LogLink):
    def gradient(self, df, f=Frame(), targets=1):
        out, w = cox_risk(df, f), f.w()
        e, r, t = F.col("e"), F.col("r"), F.col("t")
        return out.withColumn("g", F.array((e * r - F.col("event")) * w)).withColumn("h", F.array((e * r - e * e * t) * w)).drop("e", "r", "t", "risk", "time", "event")

    def intercept(self, df, f=Frame(), targets=1):
        return [1.0]


def _changes(q: pa.Array) -> np.ndarray:
    """Places of a sorted column whose value isn't that of the row before; missing values are equal, and so are NaN."""
    if pa.types.is_floating(q.type):
        q = pc.add(q, pa.scalar(0.0, q.type))  # -0.0 is 0.0
    return np.flatnonzero(np.diff(np.asarray(q.dictionary_encode(null_encoding="encode").indices))) + 1


class Rank(Objective):
    """Pairwise ranking; a query's rows are compared in one task, which takes many queries at once.

    With ``lambdarank_unbiased`` the debiasing terms in ``bias`` go into the gradients, which come with the losses by place
    (columns place, li and lj); ``settle`` sums those up and updates the terms.
    """

    bias: tuple[np.ndarray, np.ndarray] | None = None

    def unbiased(self) -> bool:
        return str(self.params.get("lambdarank_unbiased", 0)).lower() in ("1", "true")

    def places(self, df, f=Frame()) -> int:
        """Places that have debiasing terms."""
        per = self.params.get("lambdarank_num_pair_per_sample")
        if self.params.get("lambdarank_pair_method", "topk") == "topk":
            return int(per) if per is not None else 32
        return min(int(df.groupBy(f.qid).count().agg(F.max("count")).first()[0] or 0), 32)

    def settle(self, df):
        if not self.unbiased():
            return df
        plus, minus = self.bias
        li, lj = np.zeros(len(plus)), np.zeros(len(plus))
        for r in df.where(F.col("place") < len(plus)).groupBy("place").agg(F.sum("li").alias("li"), F.sum("lj").alias("lj")).collect():
            li[r["place"]], lj[r["place"]] = r["li"], r["lj"]
        power = 1 / (1 + float(self.params.get("lambdarank_bias_norm", 1)))
        self.bias = tuple((x / x[0]) ** power if len(x) and x[0] >= EPS else t for x, t in ((li, plus), (lj, minus)))
        return df.drop("place", "li", "lj")

    def gradient(self, df, f=Frame(), targets=1):
        kind, params = self.name.split(":")[1], dict(self.params)
        groups = df.select(F.col(f.qid).alias("q"), f.w().alias("w")).groupBy("q").agg(F.first("w").alias("w")).agg(F.sum("w"), F.count("*")).first() if f.weight else None
        scale = float(groups[1] / groups[0]) if groups and groups[0] else 1.0
        fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
        if self.unbiased() and self.bias is None:
            k = self.places(df, f)
            self.bias = (np.ones(k), np.ones(k))
        bias = self.bias
        names = Frame(**{k: getattr(f, k) for k in ("label", "margin", "weight", "qid", "row_id")})

        def told(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches).combine_chunks()
            n, starts = t.num_rows, np.concatenate(([0], _changes(t.column(names.qid).combine_chunks())))
            s = np.asarray(t.column(names.margin).combine_chunks().flatten(), np.float64).reshape(n, -1)[:, 0].astype(np.float32)
            y, w = np.asarray(t.column(names.label), np.float64), 1.0
            if names.weight:
                own = t.column(names.weight).take(pa.array(starts))
                if own.null_count:
                    raise ValueError("weights of queries must not be missing")
                w = np.asarray(own, np.float64) * scale
            costs = np.zeros((2, n))
            g, h = lambda_gradients(s, y, kind, params, w, bias, costs=costs, starts=starts)
            pack = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(x))
            t = t.append_column("g", pack(g)).append_column("h", pack(h))
            if bias is not None:
                place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
                t = t.append_column("place", pa.array(place)).append_column("li", pa.array(costs[0])).append_column("lj", pa.array(costs[1]))
            yield from t.to_batches(max_chunksize=CHUNK)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []  # rows of a query that may go on in the next batch
            for b in batches:
                if not b.num_rows:
                    continue
                q = b.column(names.qid)
                at = _changes(pa.concat_arrays([held[-1].column(names.qid)[-1:], q])) - 1 if held else _changes(q)
                if len(at):
                    cut = int(at[-1])
                    yield from told([*held, b.slice(0, cut)])
                    held, b = [], b.slice(cut)
                held.append(b)
            if held:
                yield from told(held)

        more = ", place long, li double, lj double" if bias is not None else ""
        rows = df.repartition(F.col(f"`{f.qid}`")).sortWithinPartitions(F.col(f"`{f.qid}`"), F.col(f"`{f.row_id}`"))
        return rows.mapInArrow(run, f"{fields}, g array<double>, h array<double>{more}")

    def intercept(self, df, f=Frame(), targets=1):
        return [0.0]

    def valid(self, y):
        return (y == F.floor(y)) & (y <= 31) & (y >= 0) if self.name == "rank:ndcg" else y.isin(0.0, 1.0) if self.name == "rank:map" else None


def stump(df: DataFrame, outputs: int = 1) -> DataFrame:
    """Best constant step of each output from the arrays g and h: one row."""
    return df.agg(*[(-F.sum(F.col("g")[i]) / F.greatest(F.sum(F.col("h")[i]), S.lit(1e-6))).alias(f"w{i}") for i in range(outputs)])


REGISTRY: dict[str, tuple[type, str]] = {
    "reg:squarederror": (SquaredError, "rmse"),
    "reg:linear": (SquaredError, "rmse"),
    "reg:logistic": (Logistic, "rmse"),
    "binary:logistic": (Logistic, "logloss"),
    "binary:logitraw": (LogitRaw, "logloss"),
    "reg:pseudohubererror": (PseudoHuber, "mphe"),
    "reg:squaredlogerror": (SquaredLogError, "rmsle"),
    "count:poisson": (Poisson, "poisson-nloglik"),
    "reg:gamma": (Gamma, "gamma-deviance"),
    "reg:tweedie": (Tweedie, ""),
    "reg:absoluteerror": (AbsoluteError, "mae"),
    "binary:hinge": (Hinge, "error"),
    "reg:normal": (Normal, "normal-nloglik"),
    "reg:quantileerror": (Quantile, "quantile"),
    "reg:expectileerror": (Expectile, "expectile"),
    "multi:softmax": (Softmax, "mlogloss"),
    "multi:softprob": (Softmax, "mlogloss"),
    "survival:aft": (Aft, "aft-nloglik"),
    "survival:cox": (Cox, "cox-nloglik"),
    "rank:ndcg": (Rank, "ndcg@32"),
    "rank:map": (Rank, "map@32"),
    "rank:pairwise": (Rank, "ndcg@32"),
}


def objective(name: str, params: dict | None = None) -> Objective:
    """The objective of a registered name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown objective {name}; known: {', '.join(REGISTRY)}")
    kind, metric = REGISTRY[name]
    return kind(name, metric, dict(params or {}))


def check_labels(df: DataFrame, obj: Objective, f: Frame = Frame()) -> DataFrame:
    """One row: n rows, n_bad labels outside the objective's domain, and valid."""
    rule = obj.valid(F.col(f.label).cast("double"))
    bad = F.count(F.when(~rule, 1)) if rule is not None else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n"), bad.alias("n_bad")).withColumn("valid", F.col("n_bad") == 0)
