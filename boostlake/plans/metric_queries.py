"""Queries of the evaluation metrics, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from boostlake.functions.metrics import metric
from boostlake.functions.objectives import Frame
from boostlake.functions.scalar import sigmoid
from boostlake.plans.base import ORDERS, orders
from boostlake.plans.objective_queries import SIG
from boostlake.plans.registry import query

FRAME = Frame(weight="w", lower="lo", upper="hi")
BY_QUERY = Frame(weight="qw", qid="qid")


def score(key: str, name: str, label: str, pred: list, sql: str, params: dict | None = None, frame: Frame = FRAME, digits: int = 6) -> None:
    """Register metric_<key>: one row with the value."""

    @query(f"metric_{key}", f"WITH {ORDERS} {sql}" if sql else None)
    def run(spark, sf_dir):
        df = orders(spark, sf_dir).withColumn("label", F.col(label)).withColumn("qw", F.col("qid") % 3 + 0.5)
        df = df.withColumn("pred", F.array(*[p() if callable(p) else F.col(p) for p in pred]))
        return metric(name, params).of(df, frame).select((F.round("value", digits) + F.lit(0.0)).alias("value"))


P = SIG.format("s")
prob = lambda: sigmoid(F.col("s"))
mu = lambda: F.exp(F.col("s"))


def mean(loss: str, end: str = "{0}") -> str:
    return f"SELECT round({end.format(f'sum(({loss}) * w) / sum(w)')}, 6) + 0.0 AS value FROM b"


score("rmse", "rmse", "yr", ["s"], mean("(s - yr) * (s - yr)", "sqrt({0})"))
score("rmsle", "rmsle", "yr", [mu], mean("pow(ln(1 + yr) - ln(1 + exp(s)), 2)", "sqrt({0})"))
score("mae", "mae", "yr", ["s"], mean("abs(s - yr)"))
score("mape", "mape", "lo", ["s"], mean("abs((lo - s) / lo)"))
score("logloss", "logloss", "yb", [prob], mean(f"CASE WHEN yb = 1 THEN -ln(greatest({P}, 1e-16)) ELSE -ln(greatest(1 - {P}, 1e-16)) END"))
score("error", "error", "yb", [prob], mean(f"CASE WHEN {P} > 0.5 THEN 1 - yb ELSE yb END"))
score("error_at", "error@0.3", "yb", [prob], mean(f"CASE WHEN {P} > 0.3 THEN 1 - yb ELSE yb END"))
score("poisson_nloglik", "poisson-nloglik", "yr", [mu], mean("lgamma(yr + 1) + exp(s) - yr * s"))
score("gamma_deviance", "gamma-deviance", "lo", [mu], "SELECT round(2 * sum((ln((exp(s) + 1e-6) / (lo + 1e-6)) + (lo + 1e-6) / (exp(s) + 1e-6) - 1) * w) / sum(w), 6) + 0.0 AS value FROM b")
score("gamma_nloglik", "gamma-nloglik", "lo", [mu], mean("lo / exp(s) + ln(exp(s))"))
score("tweedie_nloglik", "tweedie-nloglik@1.3", "yr", [mu], mean("-yr * pow(exp(s), -0.3) / (-0.3) + pow(exp(s), 0.7) / 0.7"))
score("mphe", "mphe", "yr", ["s"], mean("2.25 * (sqrt(1 + pow((yr - s) / 1.5, 2)) - 1)"), {"huber_slope": 1.5})
_PIN = "CASE WHEN yr >= {0} THEN {1} * (yr - {0}) ELSE (1 - {1}) * ({0} - yr) END"
score("quantile", "quantile", "yr", ["s", "s1"], mean(f"({_PIN.format('s', 0.1)} + {_PIN.format('s1', 0.8)}) / 2"), {"quantile_alpha": [0.1, 0.8]})
_EXP = "CASE WHEN {0} >= yr THEN 1 - {1} ELSE {1} END * ({0} - yr) * ({0} - yr)"
score("expectile", "expectile", "yr", ["s", "s1"], mean(f"({_EXP.format('s', 0.2)} + {_EXP.format('s1', 0.7)}) / 2"), {"expectile_alpha": [0.2, 0.7]})
score("normal_nloglik", "normal-nloglik", "yr", ["s", "s1"], mean("0.5 * (ln(2 * pi()) + s1 + (yr - s) * (yr - s) * exp(-s1))"))
score("merror", "merror", "yc", ["s", "s1", "s2"], mean("CASE WHEN (CASE WHEN s >= s1 AND s >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END) = yc THEN 0 ELSE 1 END"))
_SM = "(exp(CASE yc WHEN 0 THEN s WHEN 1 THEN s1 ELSE s2 END) / (exp(s) + exp(s1) + exp(s2)))"


def _softmax(k: int):
    from boostlake.functions.scalar import softmax

    return lambda: softmax([F.col("s"), F.col("s1"), F.col("s2")])[k]


score("mlogloss", "mlogloss", "yc", [_softmax(0), _softmax(1), _softmax(2)], mean(f"-ln(greatest({_SM}, 1e-16))"))
_ZL, _ZU = "((ln(lo) - s) / 1.3)", "((ln(CASE WHEN isinf(hi) THEN 1 ELSE hi END) - s) / 1.3)"
_LG = "exp({0}) / (1 + exp({0}))"
score("aft_nloglik", "aft-nloglik", "yr", ["s"], mean(f"-ln(greatest(CASE WHEN lo = hi THEN exp({_ZL}) / pow(1 + exp({_ZL}), 2) / (1.3 * lo) ELSE CASE WHEN isinf(hi) THEN 1 ELSE {_LG.format(_ZU)} END - {_LG.format(_ZL)} END, 1e-12))"), {"aft_loss_distribution": "logistic", "aft_loss_distribution_scale": 1.3})
score("interval_accuracy", "interval-regression-accuracy", "yr", ["s1"], mean("CASE WHEN exp(s1) >= lo AND exp(s1) <= hi THEN 1 ELSE 0 END"))
score("ams", "ams@0.15", "yb", ["s"], """, o AS (SELECT yb, w, s, row_number() OVER (ORDER BY s DESC, row_id) AS n, count(*) OVER () AS total FROM b),
    t AS (SELECT sum(CASE WHEN yb > 0.5 THEN w ELSE 0 END) AS s, sum(CASE WHEN yb > 0.5 THEN 0 ELSE w END) AS k FROM o WHERE n <= CAST(floor(0.15 * total) AS BIGINT))
    SELECT round(sqrt(2 * ((s + k + 10) * ln(1 + s / (k + 10)) - s)), 6) AS value FROM t""")
score("cox_nloglik", "cox-nloglik", "tc", [mu], """, k AS (SELECT tc, s, sum(exp(s)) OVER (ORDER BY abs(tc) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM b)
    SELECT round(-sum(s - ln(risk)) / count(*), 6) AS value FROM k WHERE tc > 0""")
_R = ", r AS (SELECT qid, {0} AS y, qid % 3 + CAST(0.5 AS DOUBLE) AS w, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS k, row_number() OVER (PARTITION BY qid ORDER BY {0} DESC, row_id) AS best, count(*) OVER (PARTITION BY qid) AS n FROM b)"
score("pre", "pre@5", "yb", ["s"], _R.format("yb") + ", g AS (SELECT qid, sum(CASE WHEN k <= 5 THEN y ELSE 0 END) / least(max(n), 5) AS v, any_value(w) AS w FROM r GROUP BY qid) SELECT round(sum(v * w) / sum(w), 6) AS value FROM g", frame=BY_QUERY)
_MAP = _R.format("yb") + ", c AS (SELECT *, sum(y) OVER (PARTITION BY qid ORDER BY k) AS cum FROM r), g AS (SELECT qid, CASE WHEN sum(y) > 0 THEN sum(CASE WHEN k <= {0} THEN y * cum / k ELSE 0 END) / least(sum(y), {0}) ELSE {1} END AS v, any_value(w) AS w FROM c GROUP BY qid) SELECT round(sum(v * w) / sum(w), 6) AS value FROM g"
score("map", "map@4", "yb", ["s"], _MAP.replace("{0}", "4").replace("{1}", "1"), frame=BY_QUERY)
score("map_minus", "map-", "yb", ["s"], _MAP.replace("{0}", "32").replace("{1}", "0"), frame=BY_QUERY)
_NDCG = _R.format("rel") + ", g AS (SELECT qid, sum(CASE WHEN k <= {0} THEN (pow(2, y) - 1) / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= {0} THEN (pow(2, y) - 1) / log2(best + 1) ELSE 0 END) AS ideal, any_value(w) AS w FROM r GROUP BY qid) SELECT round(sum(CASE WHEN ideal > 0 THEN dcg / ideal * w ELSE {1} END) / sum(w), 6) AS value FROM g"
score("ndcg", "ndcg@5", "rel", ["s"], _NDCG.replace("{0}", "5").replace("{1}", "1"), frame=BY_QUERY)
score("ndcg_minus", "ndcg@3-", "rel", ["s"], _NDCG.replace("{0}", "3").replace("{1}", "0"), frame=BY_QUERY)
_ROC = "u AS (SELECT {0} k, p, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM v GROUP BY ALL), t AS (SELECT *, sum(tp) OVER (PARTITION BY k ORDER BY p DESC) AS ctp, sum(fp) OVER (PARTITION BY k ORDER BY p DESC) AS cfp FROM u), a AS (SELECT k, sum(fp * (ctp - tp / 2)) AS area, sum(tp) AS pos, sum(fp) AS neg FROM t GROUP BY k)"
score("auc", "auc", "yb", ["s"], f", v AS (SELECT s AS p, yb AS y, w FROM b), {_ROC.format('0 AS')} SELECT round(area / (pos * neg), 6) AS value FROM a")
score("auc_multiclass", "auc", "yc", ["s", "s1", "s2"], f", v AS (SELECT unnest([0, 1, 2]) AS k, unnest([s, s1, s2]) AS p, unnest([CAST(yc = 0 AS INTEGER), CAST(yc = 1 AS INTEGER), CAST(yc = 2 AS INTEGER)]) AS y, w FROM b), {_ROC.format('')} SELECT round(sum(area / (pos * neg) * pos) / sum(pos), 6) AS value FROM a")
score("auc_ranking", "auc", "rel", ["s"], """, p AS (SELECT a.qid, avg(CASE WHEN a.s > c.s THEN 1.0 WHEN a.s = c.s THEN 0.5 ELSE 0 END) AS v FROM b a JOIN b c ON a.qid = c.qid AND a.rel > c.rel GROUP BY a.qid),
    n AS (SELECT qid, count(*) AS n, any_value(qid % 3 + CAST(0.5 AS DOUBLE)) AS w FROM b GROUP BY qid) SELECT round(sum(v * w) / sum(w), 6) AS value FROM p JOIN n USING (qid) WHERE n >= 3""", frame=BY_QUERY)
_PR = """CASE WHEN abs(bb) > 1e-12 THEN (r1 - r0 - bb / aa * (ln(aa * r1 + bb) - ln(aa * r0 + bb))) / aa ELSE (r1 - r0) / aa END"""
score("aucpr", "aucpr", "yb", ["s"], f""", v AS (SELECT s AS p, yb AS y, w FROM b), {_ROC.format('0 AS')},
    c AS (SELECT t.*, 1 + fp / tp AS aa, (cfp - fp - fp / tp * (ctp - tp)) / (SELECT pos FROM a) AS bb, ctp / (SELECT pos FROM a) AS r1, (ctp - tp) / (SELECT pos FROM a) AS r0 FROM t WHERE tp > 0)
    SELECT round(sum({_PR}), 6) AS value FROM c""")
