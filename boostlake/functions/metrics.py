"""Evaluation metrics: each is one aggregation of a frame with labels and predictions.

Predictions are an array ``pred`` (one entry per output) on the scale the metric expects; weights are per row, and per
query for ranking metrics. ``metric(name)`` parses ``name@parameter`` and a trailing ``-``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlake.functions import scalar as S
from boostlake.functions.objectives import Frame, cox_risk


@dataclass(frozen=True)
class Metric:
    """A metric: ``name`` as reported, ``of`` maps (frame, columns) to a one-row frame with ``value``."""

    name: str
    of: Callable[[DataFrame, Frame], DataFrame]

    @property
    def maximise(self) -> bool:
        return self.name.split("@")[0].rstrip("-") in ("auc", "aucpr", "pre", "map", "ndcg")

    def value(self, df: DataFrame, f: Frame = Frame()) -> float:
        v = self.of(df, f).first()["value"]
        return float("nan") if v is None else float(v)


def _targets(df: DataFrame, f: Frame) -> int:
    return 0 if dict(df.dtypes)[f.label].startswith("array") else 1


def row_mean(loss: Callable[[Column, Column], Column], end: Callable[[Column], Column] = lambda x: x) -> Callable:
    """Weighted mean of a loss over rows and targets; without weight the plain sum."""

    def of(df: DataFrame, f: Frame) -> DataFrame:
        if _targets(df, f):
            one = loss(F.col(f.label).cast("double"), F.col("pred")[0])
            total, weight = F.sum(one * f.w()), F.sum(f.w())
        else:
            pairs = df.select(f.w().alias("w"), F.explode(F.arrays_zip(F.col(f.label).alias("y"), F.col("pred").alias("p"))).alias("z")).select("w", "z.y", "z.p")
            df, total, weight = pairs, F.sum(loss(F.col("y").cast("double"), F.col("p")) * F.col("w")), F.sum("w")
        return df.agg(end(F.when(weight == 0, total).otherwise(total / weight)).alias("value"))

    return of


def _floor_log(p: Column) -> Column:
    return F.log(F.greatest(p, S.lit(1e-16)))


def logloss(y: Column, p: Column) -> Column:
    return F.when(y == 0, S.lit(0)).otherwise(-y * _floor_log(p)) + F.when(y == 1, S.lit(0)).otherwise(-(1.0 - y) * _floor_log(1.0 - p))


def tweedie_loss(rho: float) -> Callable:
    return lambda y, p: -y * F.pow(p, S.lit(1 - rho)) / (1 - rho) + F.pow(p, S.lit(2 - rho)) / (2 - rho)


def gamma_deviance(df: DataFrame, f: Frame) -> DataFrame:
    y, p, w = F.col(f.label).cast("double") + 1e-6, F.col("pred")[0] + 1e-6, f.w()
    return df.agg((2.0 * F.sum((F.log(p / y) + y / p - 1.0) * w) / F.sum(w)).alias("value"))


def gamma_nloglik(y: Column, p: Column) -> Column:
    theta = -1.0 / F.greatest(p, S.lit(1e-6))
    return -(y * theta + F.log(-theta))


def _over(values: list[float], loss: Callable[[Column, Column, float], Column]) -> Callable:
    """Mean over rows and a list of parameters, one per output."""

    def of(df: DataFrame, f: Frame) -> DataFrame:
        y, w = F.col(f.label).cast("double"), f.w()
        parts = [loss(y, F.col("pred")[i], a) for i, a in enumerate(values)]
        return df.agg((F.sum(sum(parts[1:], parts[0]) * w) / (F.sum(w) * len(values))).alias("value"))

    return of


def normal_nloglik(df: DataFrame, f: Frame) -> DataFrame:
    y, m, v, w = F.col(f.label).cast("double"), F.col("pred")[0], F.col("pred")[1], f.w()
    return df.agg((F.sum(0.5 * (math.log(2 * math.pi) + v + (y - m) * (y - m) * F.exp(-v)) * w) / F.sum(w)).alias("value"))


def merror(df: DataFrame, f: Frame) -> DataFrame:
    best = F.array_position("pred", F.array_max("pred")) - 1
    return df.agg((F.sum(F.when(best == F.col(f.label).cast("long"), S.lit(0)).otherwise(f.w())) / F.sum(f.w())).alias("value"))


def mlogloss(df: DataFrame, f: Frame) -> DataFrame:
    return df.agg((F.sum(-_floor_log(F.get("pred", F.col(f.label).cast("int"))) * f.w()) / F.sum(f.w())).alias("value"))


def aft_nloglik(distribution: str = "normal", sigma: float = 1.0) -> Callable:
    def of(df: DataFrame, f: Frame) -> DataFrame:
        lo, hi, s = F.col(f.lower).cast("double"), F.col(f.upper).cast("double"), F.col("pred")[0]
        zu, zl = (F.log(hi) - s) / sigma, (F.log(lo) - s) / sigma
        right, left = hi == float("inf"), lo <= 0
        u, v = S.aft_parts(F.when(right, S.lit(0)).otherwise(zu), distribution), S.aft_parts(F.when(left, S.lit(0)).otherwise(zl), distribution)
        mass = F.when(right, S.lit(1)).otherwise(u["cdf"]) - F.when(left, S.lit(0)).otherwise(v["cdf"])
        loss = -F.log(F.greatest(F.when(lo == hi, v["pdf"] / (sigma * lo)).otherwise(mass), S.lit(1e-12)))
        return df.agg((F.sum(loss * f.w()) / F.sum(f.w())).alias("value"))

    return of


def interval_accuracy(df: DataFrame, f: Frame) -> DataFrame:
    e = F.exp(F.col("pred")[0])
    return df.agg((F.sum(F.when((e >= F.col(f.lower)) & (e <= F.col(f.upper)), f.w()).otherwise(S.lit(0))) / F.sum(f.w())).alias("value"))


def ams(ratio: float) -> Callable:
    """Best approximate median significance over the top share of rows by score; ties follow row_id."""

    def of(df: DataFrame, f: Frame) -> DataFrame:
        n = df.count()
        top = min(int(ratio * n), n) if ratio else n
        ordered = df.select(F.col("pred")[0].alias("p"), F.col(f.label).alias("y"), f.w().alias("w"), F.col(f.row_id).alias("id")).orderBy(F.desc("p"), "id").limit(top)
        upto = Window.orderBy(F.desc("p"), "id").rowsBetween(Window.unboundedPreceding, 0)
        signal, noise = F.sum(F.when(F.col("y") > 0.5, F.col("w")).otherwise(S.lit(0))).over(upto), F.sum(F.when(F.col("y") > 0.5, S.lit(0)).otherwise(F.col("w"))).over(upto)
        # a row counts where the next score differs
        last = F.coalesce(F.lead("p").over(Window.orderBy(F.desc("p"), "id")) != F.col("p"), F.lit(False))
        score = ordered.select(last.alias("last"), signal.alias("s"), noise.alias("b")).withColumn("v", F.sqrt(2.0 * ((F.col("s") + F.col("b") + 10.0) * F.log(1.0 + F.col("s") / (F.col("b") + 10.0)) - F.col("s"))))
        if top == n:
            return score.agg(F.max(F.when(F.col("last"), F.col("v"))).alias("value"))
        return score.agg(F.max_by("v", F.col("s") + F.col("b")).alias("value"))

    return of


def cox_nloglik(df: DataFrame, f: Frame) -> DataFrame:
    """Predictions are hazards; the risk set of an event are the rows whose time isn't earlier."""
    risk = cox_risk(df.withColumn("__m", F.array(F.log(F.col("pred")[0]))), Frame(label=f.label, margin="__m", row_id=f.row_id))
    return risk.agg((-F.sum(F.when(F.col("event") > 0, F.log("e") - F.log("risk"))) / F.sum("event")).alias("value"))


def _ranked(df: DataFrame, f: Frame) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("p"), "id")
    rows = df.select(F.col(f.qid).alias("q"), F.col("pred")[0].alias("p"), F.col(f.label).cast("double").alias("y"), f.w().alias("w"), F.col(f.row_id).alias("id"))
    return rows.withColumn("place", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("q")))


def _mean_of_queries(groups: DataFrame) -> DataFrame:
    return groups.agg((F.sum("score") / F.sum("w")).alias("value"))


def precision(k: int) -> Callable:
    def of(df: DataFrame, f: Frame) -> DataFrame:
        g = _ranked(df, f).groupBy("q").agg(F.sum(F.when(F.col("place") <= k, F.col("y")).otherwise(S.lit(0))).alias("hits"), F.max("n").alias("n"), F.first("w").alias("w"))
        return _mean_of_queries(g.select((F.col("hits") / F.least("n", F.lit(k)) * F.col("w")).alias("score"), "w"))

    return of


def mean_average_precision(k: int, minus: bool) -> Callable:
    def of(df: DataFrame, f: Frame) -> DataFrame:
        upto = Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        hit = _ranked(df, f).withColumn("cum", F.sum("y").over(upto))
        g = hit.groupBy("q").agg(F.sum(F.when(F.col("place") <= k, F.col("y") * F.col("cum") / F.col("place")).otherwise(S.lit(0))).alias("s"), F.sum("y").alias("hits"), F.first("w").alias("w"))
        score = F.when(F.col("hits") > 0, F.col("s") / F.least("hits", S.lit(k))).otherwise(S.lit(0 if minus else 1))
        return _mean_of_queries(g.select((score * F.col("w")).alias("score"), "w"))

    return of


def ndcg(k: int, minus: bool, exponential: bool = True) -> Callable:
    def of(df: DataFrame, f: Frame) -> DataFrame:
        ranked = _ranked(df, f).withColumn("best", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("y"), "id")))
        part = lambda place: F.sum(F.when(F.col(place) <= k, S.dcg_gain(F.col("y"), exponential) * S.dcg_discount(F.col(place) - 1)).otherwise(S.lit(0)))
        g = ranked.groupBy("q").agg(part("place").alias("dcg"), part("best").alias("ideal"), F.first("w").alias("w"))
        # a query without relevant documents scores 1 (0 with -), without its weight
        score = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal") * F.col("w")).otherwise(S.lit(0 if minus else 1))
        return _mean_of_queries(g.select(score.alias("score"), "w"))

    return of


def _by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positive and negative weight (tp, fp) of each distinct score, and their running sums from the highest."""
    sums = df.groupBy(*keys, "p").agg(F.sum(F.col("w") * F.col("y")).alias("tp"), F.sum(F.col("w") * (1.0 - F.col("y"))).alias("fp"))
    by = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("ctp", F.sum("tp").over(by)).withColumn("cfp", F.sum("fp").over(by))


def _roc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve per key, with the totals."""
    area = F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2.0))
    return _by_score(df, keys).groupBy(*keys).agg(area.alias("area"), F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))


def auc(df: DataFrame, f: Frame) -> DataFrame:
    """Binary; one against the rest weighted by positives for several classes; over queries the mean of pairwise areas."""
    if f.qid:
        # the area of a query counts pairs of rows with different labels; queries of under three rows or one label don't count
        rows = df.select(F.col(f.qid).alias("q"), F.col("pred")[0].alias("p"), F.col(f.label).cast("double").alias("y"), f.w().alias("w"))
        sums = rows.groupBy("q", "p", "y").agg(F.count("*").alias("c"))
        pairs = sums.alias("a").join(sums.alias("b"), (F.col("a.q") == F.col("b.q")) & (F.col("a.y") > F.col("b.y")))
        won = F.when(F.col("a.p") > F.col("b.p"), S.lit(1)).when(F.col("a.p") == F.col("b.p"), S.lit(0.5)).otherwise(S.lit(0))
        n = F.col("a.c") * F.col("b.c")
        per = pairs.groupBy(F.col("a.q").alias("q")).agg((F.sum(n * won) / F.sum(n)).alias("auc"))
        size = rows.groupBy("q").agg(F.count("*").alias("n"), F.first("w").alias("w"))
        return per.join(size.where("n >= 3"), "q").agg((F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("value"))
    k = df.select(F.size("pred").alias("k")).first()  # outputs are alike on all rows
    if k is not None and k["k"] > 1:
        long = df.select(F.col(f.label).cast("int").alias("label"), f.w().alias("w"), F.posexplode("pred").alias("class", "p")).withColumn("y", (F.col("label") == F.col("class")).cast("double"))
        per = _roc(long, ["class"]).where("pos > 0 and neg > 0").withColumn("auc", F.col("area") / (F.col("pos") * F.col("neg")))
        return per.agg((F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("value"))
    flat = df.select(F.lit(0).alias("k"), F.col("pred")[0].alias("p"), F.col(f.label).cast("double").alias("y"), f.w().alias("w"))
    return _roc(flat, ["k"]).select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).alias("value"))


def aucpr(df: DataFrame, f: Frame) -> DataFrame:
    """Area under the precision-recall curve, interpolated between distinct scores; the mean over queries where given."""
    key = F.col(f.qid) if f.qid else F.lit(0)
    flat = df.select(key.alias("k"), F.col("pred")[0].alias("p"), F.col(f.label).cast("double").alias("y"), f.w().alias("w"))
    curve = _by_score(flat, ["k"]).withColumn("pos", F.sum("tp").over(Window.partitionBy("k"))).withColumn("neg", F.sum("fp").over(Window.partitionBy("k"))).where("tp > 0")
    h = F.col("fp") / F.col("tp")
    a, b = 1.0 + h, (F.col("cfp") - F.col("fp") - h * (F.col("ctp") - F.col("tp"))) / F.col("pos")
    r1, r0 = F.col("ctp") / F.col("pos"), (F.col("ctp") - F.col("tp")) / F.col("pos")
    step = F.when(b != 0, (r1 - r0 - b / a * (F.log(a * r1 + b) - F.log(a * r0 + b))) / a).otherwise((r1 - r0) / a)
    per = curve.where("pos > 0 and neg > 0").groupBy("k").agg(F.sum(step).alias("v"))
    return per.agg(F.avg("v").alias("value"))


SIMPLE: dict[str, Callable] = {
    "rmse": row_mean(lambda y, p: (y - p) * (y - p), F.sqrt),
    "rmsle": row_mean(lambda y, p: F.pow(F.log1p(y) - F.log1p(p), S.lit(2)), F.sqrt),
    "mae": row_mean(lambda y, p: F.abs(y - p)),
    "mape": row_mean(lambda y, p: F.abs((y - p) / y)),
    "logloss": row_mean(logloss),
    "poisson-nloglik": row_mean(lambda y, p: S.lgamma(y + 1.0) + F.greatest(p, S.lit(1e-16)) - y * F.log(F.greatest(p, S.lit(1e-16)))),
    "gamma-deviance": gamma_deviance,
    "gamma-nloglik": row_mean(gamma_nloglik),
    "normal-nloglik": normal_nloglik,
    "merror": merror,
    "mlogloss": mlogloss,
    "interval-regression-accuracy": interval_accuracy,
    "cox-nloglik": cox_nloglik,
    "auc": auc,
    "aucpr": aucpr,
}
#: Names that take parameters, of the name or of the objective.
PARAMETRIC = ("error", "tweedie-nloglik", "mphe", "quantile", "expectile", "aft-nloglik", "ams", "pre", "map", "ndcg")


def metric(name: str, params: dict | None = None) -> Metric:
    """The metric of a name such as ``ndcg@5-``; ``params`` are the objective's parameters."""
    params = dict(params or {})
    minus = name.endswith("-")
    base, _, at = name.rstrip("-").partition("@")
    if base in SIMPLE and not at:
        return Metric(base, SIMPLE[base])
    if base == "error":
        t = float(at or 0.5)
        return Metric("error" if t == 0.5 else f"error@{t:g}", row_mean(lambda y, p: F.when(p > t, 1.0 - y).otherwise(y)))
    if base == "tweedie-nloglik":
        rho = float(at or "nan")
        if not 1 <= rho < 2:
            raise ValueError("tweedie-nloglik needs a power from 1 up to 2")
        return Metric(f"tweedie-nloglik@{rho:g}", row_mean(tweedie_loss(rho)))
    if base == "mphe":
        d = float(params.get("huber_slope", 1))
        return Metric("mphe", row_mean(lambda y, p: d * d * (F.sqrt(1.0 + F.pow((y - p) / d, S.lit(2))) - 1.0)))
    if base == "quantile":
        return Metric("quantile", _over(_list(params.get("quantile_alpha", 0.5)), lambda y, p, a: F.when(y >= p, a * (y - p)).otherwise((1 - a) * (p - y))))
    if base == "expectile":
        return Metric("expectile", _over(_list(params.get("expectile_alpha", 0.5)), lambda y, p, a: F.when(p >= y, S.lit(1 - a)).otherwise(S.lit(a)) * (p - y) * (p - y)))
    if base == "aft-nloglik":
        return Metric("aft-nloglik", aft_nloglik(params.get("aft_loss_distribution", "normal"), float(params.get("aft_loss_distribution_scale", 1))))
    if base == "ams":
        return Metric(f"ams@{at}", ams(float(at)))
    k = int(at) if at else 32
    if base == "pre":
        return Metric(name, precision(k))
    if base == "map":
        return Metric(name, mean_average_precision(k, minus))
    if base == "ndcg":
        return Metric(name, ndcg(k, minus, bool(int(params.get("ndcg_exp_gain", 1)))))
    raise ValueError(f"unknown metric {name}; known: {', '.join([*SIMPLE, *PARAMETRIC])}")


def _list(x) -> list[float]:
    return [float(v) for v in (x if isinstance(x, (list, tuple)) else [x])]
