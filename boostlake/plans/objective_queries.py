"""Queries of scalar functions, objectives and intercepts, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.functions import scalar as S
from boostlake.functions.objectives import Frame, check_labels, cox_risk, objective, stump, weighted_quantile
from boostlake.plans.base import ORDERS, orders
from boostlake.plans.registry import query


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# ---- scalar functions ----

SIG = "1 / (exp(least(-({0}), 88.7)) + 1 + 1e-16)"
SOFT = "CASE WHEN {0} > {1} THEN {0} - {1} WHEN {0} < -{1} THEN {0} + {1} ELSE 0 END"


def scalar(name: str, make, sql: str) -> None:
    """Register fn_<name>: row_id and one value per order."""

    @query(f"fn_{name}", f"WITH {ORDERS} SELECT row_id, round({sql}, 6) + 0.0 AS v FROM b")
    def run(spark, sf_dir):
        return orders(spark, sf_dir).select("row_id", rounded(make()).alias("v"))


c = F.col
scalar("sigmoid", lambda: S.sigmoid(c("s")), SIG.format("s"))
scalar("sigmoid64", lambda: 1.0 / (F.exp(-c("s1")) + 1.0), "1 / (exp(-s1) + 1)")
scalar("logit", lambda: S.logit(S.sigmoid(c("s"))), f"-ln(1 / ({SIG.format('s')}) - 1)")
scalar("softmax", lambda: S.softmax([c("s"), c("s1"), c("s2")])[1], "exp(s1 - greatest(s, s1, s2)) / (exp(s - greatest(s, s1, s2)) + exp(s1 - greatest(s, s1, s2)) + exp(s2 - greatest(s, s1, s2)))")
scalar("argmax", lambda: S.argmax([c("s"), c("s1"), c("s2")]).cast("double"), "CAST(CASE WHEN s >= s1 AND s >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS DOUBLE)")
scalar("log_sum_exp", lambda: S.log_sum_exp([c("s"), c("s1"), c("s2")]), "greatest(s, s1, s2) + ln(exp(s - greatest(s, s1, s2)) + exp(s1 - greatest(s, s1, s2)) + exp(s2 - greatest(s, s1, s2)))")
scalar("softplus", lambda: S.softplus(c("s")), "ln(1 + exp(s))")
scalar("inverse_softplus", lambda: S.inverse_softplus(c("yr")), "greatest(yr, 1e-6) + ln(1 - exp(-greatest(yr, 1e-6)))")
scalar("fmax", lambda: S.fmax(F.when(c("row_id") % 5 == 0, F.lit(float("nan"))).otherwise(c("s")), c("s1")), "CASE WHEN row_id % 5 = 0 THEN s1 ELSE greatest(s, s1) END")
scalar("hypot", lambda: F.hypot(c("s"), c("s1")), "sqrt(s * s + s1 * s1)")
scalar("close_to", lambda: S.close_to(c("s"), c("s1"), 0.1).cast("double"), "CAST(CASE WHEN abs(s - s1) < 0.1 THEN 1 ELSE 0 END AS DOUBLE)")
scalar("log1p_expm1", lambda: F.log1p(c("yr")) + F.expm1(c("s")), "ln(1 + yr) + exp(s) - 1")
scalar("lgamma", lambda: S.lgamma(c("yr") + 1.0), "lgamma(yr + 1)")
scalar("threshold_l1", lambda: S.soft_threshold(c("s"), 0.3), SOFT.format("s", "0.3"))
scalar("dcg", lambda: S.dcg_gain(c("rel")) * S.dcg_discount(c("row_id") % 10), "(pow(2, rel) - 1) / log2(CAST(row_id % 10 AS DOUBLE) + 2)")
scalar("leaf_weight", lambda: S.leaf_weight(c("s"), c("w"), 1.0, 0.2, 0.7), "greatest(least(-(" + SOFT.format("s", "0.2") + ") / (w + 1), 0.7), -0.7)")
_W = "(-(" + SOFT.format("s", "0.2") + ") / (w + 1))"
scalar("split_gain", lambda: S.gain(c("s"), c("w"), 1.0, 0.2), f"-(2 * s * {_W} + (w + 1) * {_W} * {_W} + 2 * 0.2 * abs({_W}))")
scalar("coordinate_delta", lambda: S.coordinate_delta(c("s"), c("w"), c("s1"), 0.1, 0.5), "CASE WHEN s1 - (s + 0.5 * s1) / (w + 0.5) >= 0 THEN greatest(-((s + 0.5 * s1) + 0.1) / (w + 0.5), -s1) ELSE least(-((s + 0.5 * s1) - 0.1) / (w + 0.5), -s1) END")
scalar("aft_pdf_logistic", lambda: S.aft_parts(c("s"), "logistic")["pdf"], "exp(s) / ((1 + exp(s)) * (1 + exp(s)))")
scalar("aft_cdf_extreme", lambda: S.aft_parts(c("s"), "extreme")["cdf"], "1 - exp(-exp(s))")
scalar("aft_pdf_normal", lambda: S.aft_parts(c("s"), "normal")["pdf"], "exp(-s * s / 2) / sqrt(2 * pi())")

# ---- gradients ----


def grad(name: str, obj: str, label: str, g: str, h: str, params: dict | None = None, margins: tuple[str, ...] = ("s",), with_: str = "", cross: str = "", frame: Frame | None = None) -> None:
    """Register grad_<name>: row_id, g, h of the first output, weighted; several outputs as further columns."""
    gs, hs = (x.split(";") for x in (g, h))
    names = [""] if len(gs) == 1 else [str(i) for i in range(len(gs))]
    cols = ", ".join(f"round({x}, 6) + 0.0 AS g{n}, round({y}, 6) + 0.0 AS h{n}" for x, y, n in zip(gs, hs, names, strict=True))

    @query(f"grad_{name}", f"WITH {ORDERS}{with_} SELECT row_id, {cols} FROM b{cross}")
    def run(spark, sf_dir):
        df = orders(spark, sf_dir).withColumn("margin", F.array(*margins)).withColumn("label", F.col(label))
        out = objective(obj, params).gradient(df, frame or Frame(weight="w", lower="lo", upper="hi"))
        return out.select("row_id", *[x for i, n in enumerate(names) for x in (rounded(F.col("g")[i]).alias(f"g{n}"), rounded(F.col("h")[i]).alias(f"h{n}"))])


P = SIG.format("s")
grad("squarederror", "reg:squarederror", "yr", "(s - yr) * w", "w")
grad("linear", "reg:linear", "yr", "(s - yr) * w", "w")
for _n, _o in (("reg_logistic", "reg:logistic"), ("logistic", "binary:logistic"), ("logitraw", "binary:logitraw")):
    grad(_n, _o, "yb", f"({P} - yb) * w", f"greatest({P} * (1 - {P}), 1e-16) * w")
grad("logistic_pos_weight", "binary:logistic", "yb", f"({P} - yb) * w * CASE WHEN yb = 1 THEN 2.5 ELSE 1 END", f"greatest({P} * (1 - {P}), 1e-16) * w * CASE WHEN yb = 1 THEN 2.5 ELSE 1 END", {"scale_pos_weight": 2.5})
grad("pseudohuber", "reg:pseudohubererror", "yr", "(s - yr) * 1.5 / sqrt(2.25 + (s - yr) * (s - yr)) * w", "1.5 / sqrt(2.25 + (s - yr) * (s - yr)) * w", {"huber_slope": 1.5})
grad("poisson", "count:poisson", "yr", "(exp(s) - yr) * w", "(2 * exp(s) + yr) * w / 3")
grad("gamma", "reg:gamma", "yr", "(1 - yr / exp(s)) * w", "(2 * yr / exp(s) + 1) / 3 * w")
grad("tweedie", "reg:tweedie", "yr", "(exp(0.7 * s) - yr * exp(-0.3 * s)) * w", "(1.3 * yr * exp(-0.3 * s) + 1.7 * exp(0.7 * s)) * w / 3", {"tweedie_variance_power": 1.3})
_C = "(SELECT pow(sum(w * sqrt(abs(s - yr))) / sum(w), 2) AS c FROM b) z"
grad("absoluteerror", "reg:absoluteerror", "yr", "w * (s - yr) * c / sqrt(c * c + (s - yr) * (s - yr))", "w * c / sqrt(c * c + (s - yr) * (s - yr))", cross=", " + _C)
grad("hinge", "binary:hinge", "yb", "CASE WHEN s * (2 * yb - 1) < 1 THEN -(2 * yb - 1) * w ELSE 0 END", "CASE WHEN s * (2 * yb - 1) < 1 THEN w ELSE 1.17549435e-38 END")
_T = "(((s - yr) * (s - yr) + 1.1920929e-07) * exp(-s1))"
grad("normal", "reg:normal", "yr", f"w * (s - yr) * exp(-s1);w * (1 - {_T}) / 2", f"w * exp(-s1);w * (1 + 2 * {_T}) / 6", margins=("s", "s1"))
_Q = lambda s, a, c: (f"w * 0.5 * {c} * (tanh(({s} - yr) / (0.04 * {c})) + 1 - 2 * {a})", f"w * CASE WHEN {s} = yr THEN 1 ELSE greatest(tanh(({s} - yr) / (0.04 * {c})) / (({s} - yr) / (0.04 * {c})), 3e-4) END * 12.5")
_q0, _q1 = _Q("s", "0.1", "c0"), _Q("s1", "0.8", "c1")
grad("quantile", "reg:quantileerror", "yr", f"{_q0[0]};{_q1[0]}", f"{_q0[1]};{_q1[1]}", {"quantile_alpha": [0.1, 0.8]}, ("s", "s1"), cross=", (SELECT pow(sum(w * sqrt(abs(s - yr))) / sum(w), 2) AS c0, pow(sum(w * sqrt(abs(s1 - yr))) / sum(w), 2) AS c1 FROM b) z")
_E0, _E1 = "(s - yr)", "(s + 1e-6 + ln(1 + exp(s1)) - yr)"
_O = lambda d, a: f"CASE WHEN {d} >= 0 THEN 1 - {a} ELSE {a} END"
_SG = SIG.format("s1")
grad("expectile", "reg:expectileerror", "yr", f"(({_O(_E0, '0.2')}) * {_E0} + ({_O(_E1, '0.7')}) * {_E1}) * w;({_SG}) * ({_O(_E1, '0.7')}) * {_E1} * w", f"(({_O(_E0, '0.2')}) + ({_O(_E1, '0.7')})) * w;({_SG}) * ({_SG}) * ({_O(_E1, '0.7')}) * w", {"expectile_alpha": [0.2, 0.7]}, ("s", "s1"))
_M = "exp({0}) / (exp(s) + exp(s1) + exp(s2))"
_G = lambda k, s: f"({_M.format(s)} - CASE WHEN yc = {k} THEN 1 ELSE 0 END)"
for _n, _o in (("softprob", "multi:softprob"), ("softmax", "multi:softmax")):
    grad(_n, _o, "yc", ";".join(f"{_G(k, s)} * w" for k, s in enumerate(("s", "s1", "s2"))), ";".join(f"greatest(abs({_G(k, s)}) * w, 1e-16)" for k, s in enumerate(("s", "s1", "s2"))), {"num_class": 3}, ("s", "s1", "s2"))


def _aft_sql(pdf: str, cdf: str, dpdf: str, hpdf: str, sigma: float) -> tuple[str, str, str]:
    """(WITH text, g, h) of censored rows away from the limits."""
    f = lambda t, z: "(" + t.replace("@", z) + ")"
    w = f""", z AS (SELECT *, (ln(lo) - s) / {sigma} AS zl, CASE WHEN isinf(hi) THEN 0 ELSE (ln(CASE WHEN isinf(hi) THEN 1 ELSE hi END) - s) / {sigma} END AS zu FROM b),
    q AS (SELECT *, {f(pdf, 'zl')} AS pl, {f(cdf, 'zl')} AS cl, {f(dpdf, 'zl')} AS dl, {f(hpdf, 'zl')} AS hl, CASE WHEN isinf(hi) THEN 0 ELSE {f(pdf, 'zu')} END AS pu, CASE WHEN isinf(hi) THEN 1 ELSE {f(cdf, 'zu')} END AS cu, CASE WHEN isinf(hi) THEN 0 ELSE {f(dpdf, 'zu')} END AS du FROM z)"""
    g = f"least(greatest(CASE WHEN lo = hi THEN dl / ({sigma} * pl) ELSE (pu - pl) / ({sigma} * (cu - cl)) END, -15), 15) * w"
    h = f"least(greatest(CASE WHEN lo = hi THEN (dl * dl - pl * hl) / ({sigma} * {sigma} * pl * pl) ELSE ((pu - pl) * (pu - pl) - (cu - cl) * (du - dl)) / ({sigma} * {sigma} * (cu - cl) * (cu - cl)) END, 1e-16), 15) * w"
    return w, g, h


def aft(name: str, dist: str, parts: tuple[str, str, str, str], sigma: float) -> None:
    w, g, h = _aft_sql(*parts, sigma)

    @query(f"grad_aft_{name}", f"WITH {ORDERS}{w} SELECT row_id, round({g}, 5) + 0.0 AS g, round({h}, 5) + 0.0 AS h FROM q")
    def run(spark, sf_dir):
        df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yr"))
        out = objective("survival:aft", {"aft_loss_distribution": dist, "aft_loss_distribution_scale": sigma}).gradient(df, Frame(weight="w", lower="lo", upper="hi"))
        return out.select("row_id", rounded(F.col("g")[0], 5).alias("g"), rounded(F.col("h")[0], 5).alias("h"))


_E, _X = "exp(@)", "exp(@ - exp(@))"
aft("logistic", "logistic", (f"{_E} / pow(1 + {_E}, 2)", f"{_E} / (1 + {_E})", f"{_E} / pow(1 + {_E}, 2) * (1 - {_E}) / (1 + {_E})", f"{_E} / pow(1 + {_E}, 2) * ({_E} * {_E} - 4 * {_E} + 1) / pow(1 + {_E}, 2)"), 1.3)
aft("extreme", "extreme", (_X, f"1 - exp(-{_E})", f"(1 - {_E}) * {_X}", f"({_E} * {_E} - 3 * {_E} + 1) * {_X}"), 2.0)


@query("grad_aft_normal")
def grad_aft_normal(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yr"))
    out = objective("survival:aft", {"aft_loss_distribution_scale": 1.2}).gradient(df, Frame(lower="lo", upper="hi"))
    return out.select("row_id", rounded(F.col("g")[0]).alias("g"), rounded(F.col("h")[0]).alias("h"))


@query("grad_squaredlogerror", f"""WITH {ORDERS}, x AS (SELECT *, greatest(s / 2.5, -1 + 1e-6) AS m FROM b)
    SELECT row_id, round((ln(1 + m) - ln(1 + yr)) / (m + 1) * w, 6) + 0.0 AS g, round(greatest((1 - (ln(1 + m) - ln(1 + yr))) / ((m + 1) * (m + 1)), 1e-6) * w, 6) + 0.0 AS h FROM x""")
def grad_squaredlogerror(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array(F.col("s") / 2.5)).withColumn("label", F.col("yr"))
    out = objective("reg:squaredlogerror").gradient(df, Frame(weight="w"))
    return out.select("row_id", rounded(F.col("g")[0]).alias("g"), rounded(F.col("h")[0]).alias("h"))


_COX = f"""WITH {ORDERS}, e AS (SELECT row_id, s, abs(tc) AS t, CASE WHEN tc > 0 THEN 1.0::DOUBLE ELSE 0 END AS ev, exp(s) AS e FROM b),
    k AS (SELECT *, sum(e) OVER (ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM e),
    r AS (SELECT *, sum(ev / risk) OVER (ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS r, sum(ev / (risk * risk)) OVER (ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS q FROM k)"""


@query("grad_cox", f"{_COX} SELECT row_id, round(e * r - ev, 5) + 0.0 AS g, round(e * r - e * e * q, 5) + 0.0 AS h FROM r")
def grad_cox(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("tc"))
    out = objective("survival:cox").gradient(df)
    return out.select("row_id", rounded(F.col("g")[0], 5).alias("g"), rounded(F.col("h")[0], 5).alias("h"))


@query("cox_riskset", f"{_COX} SELECT row_id, round(risk, 4) AS risk, round(r, 6) AS r FROM r")
def cox_riskset(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("tc"))
    return cox_risk(df).select("row_id", F.round("risk", 4).alias("risk"), F.round("r", 6).alias("r"))


_PAIRS = """, r AS (SELECT row_id, qid, s, rel, row_number() OVER (PARTITION BY qid ORDER BY CAST(s AS FLOAT) DESC, row_id) - 1 AS pos, count(*) OVER (PARTITION BY qid) AS n, max(CAST(s AS FLOAT)) OVER (PARTITION BY qid) AS top, min(CAST(s AS FLOAT)) OVER (PARTITION BY qid) AS low FROM b),
    p AS (SELECT a.qid, a.row_id AS hi, c.row_id AS lo, CAST(CAST(a.s AS FLOAT) - CAST(c.s AS FLOAT) AS DOUBLE) AS d, a.rel AS rh, c.rel AS rl, a.pos AS ph, c.pos AS pl, a.top <> a.low AS differ FROM r a JOIN r c ON a.qid = c.qid AND a.rel > c.rel AND least(a.pos, c.pos) < 32),
    i AS (SELECT qid, sum(CASE WHEN k < 32 THEN (pow(2, rel) - 1) / log2(k + 2) ELSE 0 END) AS ideal FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) - 1 AS k FROM b) GROUP BY qid),
    l AS (SELECT p.*, 1 / (1 + exp(least(-d, 88.7)) + 1e-16) AS sg, {delta} AS delta FROM p JOIN i USING (qid)),
    m AS (SELECT *, (sg - 1) * delta AS lam, greatest(sg * (1 - sg), 1e-16) * delta * 2 AS he FROM l),
    t AS (SELECT qid, -2 * sum(lam) AS total FROM m GROUP BY qid),
    u AS (SELECT qid, hi AS row_id, lam AS g, he AS h FROM m UNION ALL SELECT qid, lo, -lam, he FROM m)
    SELECT b.row_id, round(coalesce(sum(g) * any_value(CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END), 0), 5) + 0.0 AS g, round(coalesce(sum(h) * any_value(CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END), 0), 5) + 0.0 AS h
    FROM b LEFT JOIN u ON u.row_id = b.row_id LEFT JOIN t ON t.qid = b.qid GROUP BY b.row_id"""
_NDCG = "abs((pow(2, rh) - pow(2, rl)) * (1 / log2(ph + 2) - 1 / log2(pl + 2))) / ideal / CASE WHEN differ THEN abs(d) + 0.01 ELSE 1 END"


def rank(name: str, sql: str | None) -> None:
    @query(f"grad_{name}", sql)
    def run(spark, sf_dir):
        y = "yb" if name == "rank_map" else "rel"
        df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col(y))
        out = objective(name.replace("_", ":")).gradient(df, Frame(qid="qid"))
        return out.select("row_id", rounded(F.col("g")[0], 5).alias("g"), rounded(F.col("h")[0], 5).alias("h"))


rank("rank_ndcg", f"WITH {ORDERS}" + _PAIRS.format(delta=_NDCG))
rank("rank_pairwise", f"WITH {ORDERS}" + _PAIRS.format(delta="1"))
_MAPD = """CASE WHEN ph < pl THEN abs(nl / (pl + 1) - nh / (ph + 1) - (al - ah)) ELSE abs(nh / (ph + 1) - (nl + 1) / (pl + 1) - (ah1 - al0)) END / hits / CASE WHEN differ THEN abs(d) + 0.01 ELSE 1 END"""
_MAP_PAIRS = _PAIRS.replace("rel", "yb").replace(
    "p AS (SELECT", """s AS (SELECT *, sum(yb) OVER (PARTITION BY qid ORDER BY pos) AS cum, sum(yb / (pos + 1)) OVER (PARTITION BY qid ORDER BY pos) AS acc, sum(yb) OVER (PARTITION BY qid) AS hits FROM r),
    p AS (SELECT a.cum AS nh, c.cum AS nl, a.acc AS ah, c.acc - c.yb / (c.pos + 1) AS al, a.acc - a.yb / (a.pos + 1) AS ah1, c.acc AS al0, a.hits AS hits,"""
).replace("FROM r a JOIN r c", "FROM s a JOIN s c")
rank("rank_map", f"WITH {ORDERS}" + _MAP_PAIRS.format(delta=_MAPD))


@query("grad_custom", f"WITH {ORDERS} SELECT row_id, round((s - yr) / sqrt(1 + (s - yr) * (s - yr)), 6) + 0.0 AS g, round(1 / pow(1 + (s - yr) * (s - yr), 1.5), 6) + 0.0 AS h FROM b")
def grad_custom(spark, sf_dir):
    d = F.col("s") - F.col("yr")
    return orders(spark, sf_dir).select("row_id", rounded(d / F.sqrt(1.0 + d * d)).alias("g"), rounded(1.0 / F.pow(1.0 + d * d, F.lit(1.5))).alias("h"))


# ---- intercepts, stumps and label checks ----


def start(name: str, obj: str, label: str, sql: str, params: dict | None = None) -> None:
    """Register intercept_<name>: one row per output."""

    @query(f"intercept_{name}", f"WITH {ORDERS} {sql}")
    def run(spark, sf_dir):
        df = orders(spark, sf_dir).withColumn("label", F.col(label))
        found = objective(obj, params).intercept(df, Frame(weight="w", lower="lo", upper="hi"))
        return spark.createDataFrame([(i, round(v, 5) + 0.0) for i, v in enumerate(found)], "output int, base double")


_mean = "SELECT 0 AS output, round(sum({0} * w) / sum(w), 5) AS base FROM b"
start("squarederror", "reg:squarederror", "yr", _mean.format("yr"))
start("logistic", "binary:logistic", "yb", _mean.format("yb"))
start("logistic_pos_weight", "binary:logistic", "yb", "SELECT 0 AS output, round(sum(yb * w * CASE WHEN yb = 1 THEN 2.5 ELSE 1 END) / sum(w * CASE WHEN yb = 1 THEN 2.5 ELSE 1 END), 5) AS base FROM b", {"scale_pos_weight": 2.5})
start("logitraw", "binary:logitraw", "yb", "SELECT 0 AS output, round(-ln(1 / (sum(yb * w) / sum(w)) - 1), 5) AS base FROM b")
start("poisson", "count:poisson", "yr", _mean.format("yr"))
start("gamma", "reg:gamma", "yr", _mean.format("yr"))
start("tweedie", "reg:tweedie", "yr", _mean.format("yr"))
start("hinge", "binary:hinge", "yb", "SELECT 0 AS output, CASE WHEN sum(yb * w) / sum(w) > 0.5 THEN 1.0::DOUBLE WHEN sum(yb * w) / sum(w) < 0.5 THEN -1.0 ELSE 0 END AS base FROM b")
start("squaredlogerror", "reg:squaredlogerror", "yr", "SELECT 0 AS output, round(exp(sum(ln(1 + yr) * w) / sum(w)) - 1, 5) AS base FROM b")
start("pseudohuber", "reg:pseudohubererror", "yr", "SELECT 0 AS output, round(sum(yr / sqrt(1 + yr * yr) * w) / sum(w / sqrt(1 + yr * yr)), 5) AS base FROM b")
_WQ = "SELECT {0} AS output, min(v) AS base FROM (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM (SELECT yr AS v, sum(w) AS w FROM b GROUP BY yr)) WHERE c >= {1} * t"
start("absoluteerror", "reg:absoluteerror", "yr", _WQ.format(0, 0.5))
start("quantile", "reg:quantileerror", "yr", _WQ.format(0, 0.1) + " UNION ALL " + _WQ.format(1, 0.8), {"quantile_alpha": [0.1, 0.8]})
start("normal", "reg:normal", "yr", "SELECT unnest([0, 1]) AS output, unnest([round(sum(yr * w) / sum(w), 5), round(ln(sum(yr * yr * w) / sum(w) - pow(sum(yr * w) / sum(w), 2) + 1.1920929e-07), 5)]) AS base FROM b")
start("softprob", "multi:softprob", "yc", "SELECT CAST(k AS INTEGER) AS output, round(l - avg(l) OVER (), 5) + 0.0 AS base FROM (SELECT yc AS k, ln(sum(w) / (SELECT sum(w) FROM b) + 1e-6) AS l FROM b GROUP BY yc)", {"num_class": 3})
start("aft", "survival:aft", "yr", "SELECT 0 AS output, 0.5::DOUBLE AS base")
start("cox", "survival:cox", "tc", "SELECT 0 AS output, 1.0::DOUBLE AS base")


@query("fit_stump", f"WITH {ORDERS} SELECT round(-sum((s - yr) * w) / greatest(sum(w), 1e-6), 6) AS w0 FROM b")
def fit_stump(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yr"))
    return stump(objective("reg:squarederror").gradient(df, Frame(weight="w"))).select(F.round("w0", 6).alias("w0"))


@query("grad_root_sum", f"WITH {ORDERS} SELECT round(sum({P} - yb), 4) AS g, round(sum({P} * (1 - {P})), 4) AS h FROM b")
def grad_root_sum(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yb"))
    return objective("binary:logistic").gradient(df).agg(F.round(F.sum(F.col("g")[0]), 4).alias("g"), F.round(F.sum(F.col("h")[0]), 4).alias("h"))


@query("validate_labels", f"""WITH {ORDERS} SELECT * FROM (
    SELECT 'binary:logistic' AS objective, count(*) AS n, count(*) FILTER (WHERE NOT (yr >= 0 AND yr <= 1)) AS n_bad FROM b UNION ALL SELECT 'count:poisson', count(*), count(*) FILTER (WHERE NOT yr >= 0) FROM b UNION ALL
    SELECT 'reg:gamma', count(*), count(*) FILTER (WHERE NOT yr > 0) FROM b UNION ALL SELECT 'binary:hinge', count(*), count(*) FILTER (WHERE yr NOT IN (0, 1)) FROM b UNION ALL SELECT 'rank:ndcg', count(*), count(*) FILTER (WHERE NOT (yr = floor(yr) AND yr <= 31 AND yr >= 0)) FROM b)""")
def validate_labels(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("label", F.col("yr"))
    parts = [check_labels(df, objective(n)).select(F.lit(n).alias("objective"), "n", "n_bad") for n in ("binary:logistic", "count:poisson", "reg:gamma", "binary:hinge", "rank:ndcg")]
    out: DataFrame = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("radix_select_quantile", f"WITH {ORDERS} {_WQ.format(0, 0.25).replace('0 AS output, ', '')}")
def radix_select_quantile(spark, sf_dir):
    return spark.createDataFrame([(weighted_quantile(orders(spark, sf_dir), F.col("yr"), F.col("w"), 0.25),)], "base double")


def transform(name: str, obj: str, sql: str, margins: tuple[str, ...] = ("s",), params: dict | None = None) -> None:
    @query(f"transform_{name}", f"WITH {ORDERS} SELECT row_id, round({sql}, 6) + 0.0 AS v FROM b")
    def run(spark, sf_dir):
        return orders(spark, sf_dir).select("row_id", rounded(objective(obj, params).transform([F.col(m) for m in margins])[-1]).alias("v"))


transform("logistic", "binary:logistic", P)
transform("poisson", "count:poisson", "exp(s)")
transform("hinge", "binary:hinge", "CAST(CASE WHEN s > 0 THEN 1 ELSE 0 END AS DOUBLE)")
transform("quantile", "reg:quantileerror", "greatest(s, s1, s2)", ("s", "s1", "s2"), {"quantile_alpha": [0.1, 0.5, 0.9]})
transform("expectile", "reg:expectileerror", "s + 1e-6 + ln(1 + exp(s1))", ("s", "s1"), {"expectile_alpha": [0.2, 0.7]})
transform("softmax", "multi:softmax", "CAST(CASE WHEN s >= s1 AND s >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS DOUBLE)", ("s", "s1", "s2"), {"num_class": 3})
