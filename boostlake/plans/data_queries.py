"""Queries of sources, projections, joins, aggregates, bins, histograms and split search, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.operators import cuts, prep, splits
from boostlake.plans.base import ORDERS, orders
from boostlake.plans.registry import query, read
from boostlake.sources import matrix, text

FEATURES = ["price", "prio", "days"]


@query("scan_dense", f"WITH {ORDERS} SELECT row_id, CAST(price AS DOUBLE) AS f0, CAST(prio AS DOUBLE) AS f1, CAST(days AS DOUBLE) AS f2 FROM b")
def scan_dense(spark, sf_dir):
    x = matrix.dense(orders(spark, sf_dir), FEATURES, keep=["row_id"])
    return x.select("row_id", *[F.col("x")[i].cast("double").alias(f"f{i}") for i in range(3)])


@query("filter_missing", f"WITH {ORDERS} SELECT row_id, CAST(CASE WHEN prio = 3 THEN NULL ELSE prio END AS DOUBLE) AS v FROM b")
def filter_missing(spark, sf_dir):
    return orders(spark, sf_dir).select("row_id", matrix.valid(F.col("prio"), 3.0).cast("double").alias("v"))


@query("scan_csr", f"WITH {ORDERS} SELECT row_id, i AS feature, CAST(v AS DOUBLE) AS fvalue FROM (SELECT row_id, unnest([0, 1, 2]) AS i, unnest([price, CAST(prio AS FLOAT), days]) AS v FROM b) WHERE v IS NOT NULL")
def scan_csr(spark, sf_dir):
    return matrix.scatter(matrix.entries(orders(spark, sf_dir), FEATURES)).select("row_id", "feature", F.col("fvalue").cast("double").alias("fvalue"))


@query("scan_csc", f"WITH {ORDERS}, e AS (SELECT row_id, unnest([0, 1, 2]) AS i, unnest([price, CAST(prio AS FLOAT), days]) AS v FROM b) SELECT row_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS features FROM e WHERE v IS NOT NULL GROUP BY row_id")
def scan_csc(spark, sf_dir):
    cells = prep.transpose(orders(spark, sf_dir), FEATURES)
    return matrix.gather(cells).select("row_id", F.size("entries").cast("long").alias("n"), F.array_join(F.transform("entries", lambda e: e["index"].cast("string")), ",").alias("features"))


@query("scan_columnar", "SELECT p_partkey AS row_id, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE dense_rank() OVER (ORDER BY p_brand) - 1 END AS DOUBLE) AS brand, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price FROM part")
def scan_columnar(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    codes = prep.dictionary(part, "p_brand")
    coded = prep.recode(part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", codes)
    return coded.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("code")).cast("double").alias("brand"), F.col("p_retailprice").cast("float").cast("double").alias("price"))


@query("parse_libsvm", "SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS label, CAST(p_partkey % 4 AS DOUBLE) + 1 AS weight, p_partkey // 10 AS qid, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS n, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS last FROM part")
def parse_libsvm(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    line = F.concat(F.col("p_size"), F.lit(":"), F.col("p_partkey") % 4 + 1, F.lit(" qid:"), F.floor(F.col("p_partkey") / 10), F.when(F.col("p_size") % 3 == 0, "").otherwise(" 0"), F.lit(" 5:"), F.col("p_retailprice"), F.lit(" # "), F.col("p_name"))
    out = text.parse_libsvm(p.select(F.col("p_partkey").alias("row_id"), line.alias("value")))
    return out.select("row_id", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "qid", F.size("entries").alias("n"), F.element_at("entries", -1)["fvalue"].cast("double").alias("last"))


@query("parse_csv", "SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS label, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS DOUBLE) AS f0, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS f1 FROM part")
def parse_csv(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    line = F.concat(F.when(F.col("p_size") % 3 == 0, "na").otherwise(F.col("p_size").cast("string")), F.lit(","), F.col("p_size"), F.lit(","), F.col("p_retailprice"))
    out = text.parse_csv(p.select(F.col("p_partkey").alias("row_id"), line.alias("value")), label_column=1)
    return out.select("row_id", F.col("label").cast("double").alias("label"), F.col("x")[0].cast("double").alias("f0"), F.col("x")[1].cast("double").alias("f1"))


@query("export_csr", f"WITH {ORDERS}, n AS (SELECT row_id, 2 + CASE WHEN days IS NULL THEN 0 ELSE 1 END AS n FROM b) SELECT row_id, CAST(sum(n) OVER (ORDER BY row_id) - n AS BIGINT) AS indptr, n FROM n")
def export_csr(spark, sf_dir):
    rows = matrix.entries(orders(spark, sf_dir), FEATURES).withColumn("n", F.size("entries"))
    return prep.group_pointers(rows, "row_id", "n").select("row_id", F.col("start").alias("indptr"), (F.col("end") - F.col("start")).cast("int").alias("n"))


@query("row_slice", f"WITH {ORDERS}, w AS (SELECT row_id * 2 AS pos, row_id FROM b WHERE row_id % 11 = 0 UNION ALL SELECT row_id * 2 + 1, row_id FROM b WHERE row_id % 22 = 0) SELECT pos, row_id, prio FROM w JOIN b USING (row_id)")
def row_slice(spark, sf_dir):
    o = orders(spark, sf_dir)
    wanted = o.where("row_id % 11 = 0").select((F.col("row_id") * 2).alias("pos"), "row_id").unionByName(o.where("row_id % 22 = 0").select((F.col("row_id") * 2 + 1).alias("pos"), "row_id"))
    return prep.take_rows(o.select("row_id", "prio"), wanted).select("pos", "row_id", "prio")


@query("transpose_to_columns", f"WITH {ORDERS} SELECT i AS feature, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 0) AS total FROM (SELECT unnest([0, 1, 2]) AS i, unnest([price, CAST(prio AS FLOAT), days]) AS v FROM b) WHERE v IS NOT NULL GROUP BY i")
def transpose_to_columns(spark, sf_dir):
    return prep.transpose(orders(spark, sf_dir), FEATURES).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum(F.col("fvalue").cast("double")), 0).alias("total"))


@query("reindex_columns", f"WITH {ORDERS} SELECT i + 10 AS feature, count(*) AS n FROM (SELECT unnest([0, 1, 2]) AS i, unnest([price, CAST(prio AS FLOAT), days]) AS v FROM b) WHERE v IS NOT NULL GROUP BY i")
def reindex_columns(spark, sf_dir):
    return matrix.scatter(matrix.reindex(matrix.entries(orders(spark, sf_dir), FEATURES), 10)).groupBy("feature").agg(F.count("*").alias("n"))


@query("group_ptr", f"WITH {ORDERS}, g AS (SELECT qid, count(*) AS n FROM b GROUP BY qid) SELECT qid, CAST(sum(n) OVER (ORDER BY qid) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY qid) AS BIGINT) AS \"end\" FROM g")
def group_ptr(spark, sf_dir):
    return prep.group_pointers(orders(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n")), "qid", "n")


@query("qid_rle", f"WITH {ORDERS} SELECT qid, min(row_id) AS first, count(*) AS n FROM b GROUP BY qid")
def qid_rle(spark, sf_dir):
    return prep.query_runs(orders(spark, sf_dir), "qid", "row_id")


@query("unroll_group_weights", f"WITH {ORDERS} SELECT row_id, CAST(qid % 3 AS DOUBLE) + 1 AS gw FROM b")
def unroll_group_weights(spark, sf_dir):
    o = orders(spark, sf_dir).select("row_id", "qid")
    return prep.unroll_weights(o, o.select("qid").distinct().withColumn("gw", (F.col("qid") % 3).cast("double") + 1), "qid").select("row_id", "gw")


@query("column_density", f"WITH {ORDERS} SELECT unnest(['price', 'prio', 'days']) AS feature, unnest([count(price), count(prio), count(days)]) AS valid, unnest([count(price) / count(*), count(prio) / count(*), round(count(days) / count(*), 6)]) AS density FROM b")
def column_density(spark, sf_dir):
    return prep.density(orders(spark, sf_dir), FEATURES).withColumn("density", F.round("density", 6))


@query("label_abs_sort", f"WITH {ORDERS} SELECT row_id, row_number() OVER (ORDER BY abs(tc), row_id) AS place FROM b")
def label_abs_sort(spark, sf_dir):
    from pyspark.sql import Window

    # the order within a time is local, the number of rows before it comes from counts per time
    o = orders(spark, sf_dir).select("row_id", F.abs("tc").alias("t"))
    before = prep.group_pointers(o.groupBy("t").agg(F.count("*").alias("n")), "t", "n")
    own = o.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("row_id")))
    return own.join(F.broadcast(before), "t").select("row_id", (F.col("start") + F.col("k")).alias("place"))  # times are 60


@query("rank_within_query", f"WITH {ORDERS} SELECT row_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS place FROM b")
def rank_within_query(spark, sf_dir):
    return prep.rank_within(orders(spark, sf_dir), "qid", "s", "row_id").select("row_id", F.col("place").cast("long").alias("place"))


@query("category_recode", "SELECT p_partkey AS row_id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM part")
def category_recode(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return prep.recode(part, "p_type", prep.dictionary(part, "p_type")).select(F.col("p_partkey").alias("row_id"), "code")


@query("ordinal_encode", "SELECT c_custkey AS row_id, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE NULL END AS DOUBLE) AS code FROM customer")
def ordinal_encode(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = spark.createDataFrame([("AUTOMOBILE", 0), ("BUILDING", 1)], "c_mktsegment string, code int")
    return c.join(F.broadcast(known), "c_mktsegment", "left").select(F.col("c_custkey").alias("row_id"), F.col("code").cast("double").alias("code"))  # two categories


@query("one_hot", f"WITH {ORDERS} SELECT row_id, CAST(prio = 1 AS INTEGER) AS p1, CAST(prio = 2 AS INTEGER) AS p2, CAST(prio = 3 AS INTEGER) AS p3 FROM b")
def one_hot(spark, sf_dir):
    return prep.one_hot(orders(spark, sf_dir).select("row_id", "prio"), "prio", [1, 2, 3], "p").drop("prio")


@query("concat_matrices", f"WITH {ORDERS} SELECT row_id, qid FROM b WHERE row_id % 2 = 0 UNION ALL SELECT row_id, qid + (SELECT max(qid) + 1 FROM b WHERE row_id % 2 = 0) FROM b WHERE row_id % 2 = 1")
def concat_matrices(spark, sf_dir):
    o = orders(spark, sf_dir).select("row_id", "qid")
    return prep.concat([o.where("row_id % 2 = 0"), o.where("row_id % 2 = 1")], "qid")


@query("sample_mean", f"WITH {ORDERS} SELECT round(sum(yr * w) / sum(w), 6) AS value FROM b")
def sample_mean(spark, sf_dir):
    return prep.weighted_mean(orders(spark, sf_dir), F.col("yr"), F.col("w")).select(F.round("value", 6).alias("value"))


@query("quantile_nist", f"WITH {ORDERS}, o AS (SELECT price AS v, row_number() OVER (ORDER BY price) AS k, count(*) OVER () AS n FROM b), x AS (SELECT 0.3 * (max(n) + 1) AS x FROM o) SELECT round(CAST(a.v + (x - floor(x)) * (c.v - a.v) AS DOUBLE), 1) AS value FROM x JOIN o a ON a.k = floor(x) JOIN o c ON c.k = floor(x) + 1")
def quantile_nist(spark, sf_dir):
    return prep.nist_quantile(orders(spark, sf_dir), "price", 0.3).select(F.round(F.col("value").cast("double"), 1).alias("value"))


@query("quantile_weighted", f"WITH {ORDERS}, g AS (SELECT prio AS v, sum(w) AS w FROM b GROUP BY prio) SELECT CAST(min(v) AS DOUBLE) AS value FROM (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM g) WHERE c >= 0.5 * t")
def quantile_weighted(spark, sf_dir):
    from boostlake.functions.objectives import weighted_quantile

    return spark.createDataFrame([(weighted_quantile(orders(spark, sf_dir), F.col("prio").cast("double"), F.col("w"), 0.5),)], "value double")


@query("class_histogram", f"WITH {ORDERS} SELECT yc, round(sum(w), 4) AS w FROM b GROUP BY yc")
def class_histogram(spark, sf_dir):
    return prep.class_histogram(orders(spark, sf_dir), "yc", F.col("w")).select("yc", F.round("w", 4).alias("w"))


@query("confusion_matrix", f"WITH {ORDERS} SELECT CAST(yb AS INTEGER) AS label, CAST(s > 0 AS INTEGER) AS predicted, count(*) AS n FROM b GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return prep.confusion(orders(spark, sf_dir).select(F.col("yb").cast("int").alias("label"), (F.col("s") > 0).cast("int").alias("predicted")), "label", "predicted")


@query("r2_score", f"WITH {ORDERS} SELECT round(1 - sum((yr - s) * (yr - s)) / (var_pop(yr) * count(*)), 6) AS value FROM b")
def r2_score(spark, sf_dir):
    return prep.r_squared(orders(spark, sf_dir), F.col("yr"), F.col("s")).select(F.round("value", 6).alias("value"))


# ---- cuts and bins ----

LINES = "l AS (SELECT CAST(l_quantity AS FLOAT) AS q, CAST(l_discount AS FLOAT) AS d, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS y FROM lineitem)"
_CUTS = "(SELECT row_number() OVER (ORDER BY v) - 1 AS bin, v AS low, coalesce(lead(v) OVER (ORDER BY v), CAST(v + (abs(v) + CAST(1e-5 AS FLOAT)) AS FLOAT)) AS cut FROM (SELECT DISTINCT {0} AS v FROM l))"


def lines(spark, sf_dir) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_quantity").cast("float").alias("q"), F.col("l_discount").cast("float").alias("d"), (F.col("l_returnflag") == "R").cast("int").cast("double").alias("y"))


@query("quantile_cuts_exact", f"WITH {LINES} SELECT CAST(bin AS INTEGER) AS bin, round(CAST(cut AS DOUBLE), 5) AS cut FROM {_CUTS.format('d')}")
def quantile_cuts_exact(spark, sf_dir):
    return cuts.distinct_cuts(lines(spark, sf_dir), "d").select("bin", F.round(F.col("cut").cast("double"), 5).alias("cut"))


@query("quantile_cuts_export", f"WITH {LINES} SELECT 0 AS feature, CAST(bin AS INTEGER) AS bin, round(CAST(cut AS DOUBLE), 5) AS cut FROM {_CUTS.format('q')} UNION ALL SELECT 1, CAST(bin AS INTEGER), round(CAST(cut AS DOUBLE), 5) FROM {_CUTS.format('d')} UNION ALL SELECT unnest([0, 1]), -1, CAST('-inf' AS DOUBLE)")
def quantile_cuts_export(spark, sf_dir):
    found = cuts.build(lines(spark, sf_dir), ["q", "d"], 256)
    rows = [(f, b, round(c, 5)) for f, b, c, _ in found.rows()] + [(f, -1, float("-inf")) for f in range(2)]
    return spark.createDataFrame(rows, "feature int, bin int, cut double")


@query("quantile_sketch")
def quantile_sketch(spark, sf_dir):
    found = cuts.build(read(spark, sf_dir, "lineitem"), ["l_extendedprice"], 64)
    return spark.createDataFrame([(b, round(c, 2)) for _, b, c, _ in found.rows()], "bin int, cut double")


@query("bin_lookup", f"WITH {LINES}, c AS {_CUTS.format('d')} SELECT round(CAST(d AS DOUBLE), 2) AS d, CAST(c.bin AS INTEGER) AS bin, count(*) AS n FROM l JOIN c ON l.d >= c.low AND l.d < c.cut GROUP BY ALL")
def bin_lookup(spark, sf_dir):
    df = lines(spark, sf_dir)
    held = [r["cut"] for r in cuts.distinct_cuts(df, "d").orderBy("bin").collect()]  # at most max_bin
    return df.select(F.round(F.col("d").cast("double"), 2).alias("d"), cuts.bin_of(F.col("d"), held).alias("bin")).groupBy("d", "bin").agg(F.count("*").alias("n"))


def binned(spark, sf_dir) -> DataFrame:
    """Orders with bins of prio and of days by year (missing days are -1), logistic gradients at margin 0 and a node."""
    o = orders(spark, sf_dir)
    return o.select("row_id", (F.col("prio") - 1).alias("b0"), F.coalesce(F.floor(F.col("days") / 400).cast("int"), F.lit(-1)).alias("b1"), (F.col("row_id") % 2).cast("int").alias("node"), (0.5 - F.col("yb")).alias("g"), F.lit(0.25).alias("h"), (F.col("s") - F.col("yr")).alias("g2"), F.col("w").alias("h2"))


BINNED = f"""{ORDERS}, x AS (SELECT row_id, prio - 1 AS b0, CASE WHEN days IS NULL THEN -1 ELSE CAST(floor(days / 400) AS INTEGER) END AS b1, CAST(row_id % 2 AS INTEGER) AS node, CAST(0.5 AS DOUBLE) - yb AS g, CAST(0.25 AS DOUBLE) AS h, s - yr AS g2, w AS h2 FROM b),
    e AS (SELECT node, unnest([0, 1]) AS feature, unnest([b0, b1]) AS bin, g, h FROM x), hist AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM e WHERE bin >= 0 GROUP BY ALL), tot AS (SELECT node, sum(g) AS tg, sum(h) AS th FROM x GROUP BY node)"""


def hist_of(df: DataFrame, g: str = "g", h: str = "h") -> tuple[DataFrame, DataFrame]:
    hist = splits.histogram(df, {"b0": F.col("b0"), "b1": F.col("b1")}, F.col("node"), F.col(g), F.col(h))
    return hist, df.groupBy("node").agg(F.sum(g).alias("tg"), F.sum(h).alias("th"))


@query("bin_matrix", f"WITH {BINNED} SELECT row_id, b0, b1 FROM x")
def bin_matrix(spark, sf_dir):
    o = orders(spark, sf_dir)
    edges = [float(400 * k) for k in range(1, 12)]
    return o.select("row_id", cuts.bin_of(F.col("prio"), [2.0, 3.0, 4.0, 5.0, 6.0]).alias("b0"), cuts.bin_of(F.col("days"), edges).alias("b1"))


@query("bin_hit_count", f"WITH {BINNED} SELECT feature, bin, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY ALL")
def bin_hit_count(spark, sf_dir):
    return hist_of(binned(spark, sf_dir))[0].groupBy("feature", "bin").agg(F.sum("n").alias("n"))


@query("category_bins", "SELECT CAST(i AS INTEGER) AS bin FROM range(0, (SELECT max(p_size) + 1 FROM part)) t(i)")
def category_bins(spark, sf_dir):
    found = cuts.build(read(spark, sf_dir, "part"), ["p_size"], 256, [True])
    return spark.createDataFrame([(b,) for _, b, _, _ in found.rows()], "bin int")


@query("grad_histogram", f"WITH {BINNED} SELECT node, feature, bin, round(g, 4) + 0.0 AS g, round(h, 4) AS h, n FROM hist")
def grad_histogram(spark, sf_dir):
    return hist_of(binned(spark, sf_dir))[0].select("node", "feature", "bin", (F.round("g", 4) + 0.0).alias("g"), F.round("h", 4).alias("h"), "n")


@query("hist_subtract", f"WITH {BINNED}, p AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY ALL) SELECT p.feature, p.bin, round(p.g - coalesce(c.g, 0), 4) + 0.0 AS g, round(p.h - coalesce(c.h, 0), 4) AS h, p.n - coalesce(c.n, 0) AS n FROM p LEFT JOIN (SELECT * FROM hist WHERE node = 1) c USING (feature, bin)")
def hist_subtract(spark, sf_dir):
    df = binned(spark, sf_dir)
    hist, _ = hist_of(df)
    parent = hist.groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return splits.subtract(parent, hist.where("node = 1")).select("feature", "bin", (F.round("g", 4) + 0.0).alias("g"), F.round("h", 4).alias("h"), "n")


def gain_sql(g: str, h: str, lam: str = "1") -> str:
    return f"CASE WHEN {h} > 0 THEN ({g}) * ({g}) / ({h} + {lam}) ELSE 0 END"


_SCAN = f"""{BINNED}, r AS (SELECT hist.node, feature, bin, tg, th, sum(g) OVER w AS cg, sum(h) OVER w AS ch, sum(g) OVER (PARTITION BY hist.node, feature) AS sg, sum(h) OVER (PARTITION BY hist.node, feature) AS sh FROM hist JOIN tot USING (node) WINDOW w AS (PARTITION BY hist.node, feature ORDER BY bin)),
    c AS (SELECT node, feature, bin, tg, th, false AS default_left, cg AS gl, ch AS hl FROM r UNION ALL SELECT node, feature, bin, tg, th, true, cg + tg - sg, ch + th - sh FROM r WHERE abs(sh - th) > 1e-9),
    d AS (SELECT *, tg - gl AS gr, th - hl AS hr, {gain_sql('gl', 'hl')} + CASE WHEN th - hl > 1e-9 THEN {gain_sql('(tg - gl)', '(th - hl)')} ELSE 0 END - {gain_sql('tg', 'th')} AS gain, hl > 0 AND th - hl > 1e-9 AND hl >= 1 AND th - hl >= 1 AS valid FROM c)"""


@query("split_scan", f"WITH {_SCAN} SELECT node, feature, bin, default_left, round(gain, 5) + 0.0 AS gain FROM d WHERE valid")
def split_scan(spark, sf_dir):
    return splits.scan(*hist_of(binned(spark, sf_dir))).where("valid").select("node", "feature", "bin", "default_left", (F.round("gain", 5) + 0.0).alias("gain"))


@query("best_split", f"WITH {_SCAN} SELECT node, feature, bin, default_left, round(gain, 5) + 0.0 AS gain FROM d WHERE valid QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature, default_left, bin) = 1")
def best_split(spark, sf_dir):
    return splits.best(splits.scan(*hist_of(binned(spark, sf_dir)))).select("node", "feature", "bin", "default_left", (F.round("gain", 5) + 0.0).alias("gain"))


@query("split_monotone", f"WITH {_SCAN} SELECT node, feature, bin, default_left, round(gain, 5) + 0.0 AS gain FROM d WHERE valid AND -gl / (hl + 1) <= -gr / (hr + 1)")
def split_monotone(spark, sf_dir):
    return splits.scan(*hist_of(binned(spark, sf_dir)), monotone=1).where("valid").select("node", "feature", "bin", "default_left", (F.round("gain", 5) + 0.0).alias("gain"))


@query("split_onehot", f"WITH {BINNED} SELECT node, feature, bin, round({gain_sql('(tg - g)', '(th - h)')} + {gain_sql('g', 'h')} - {gain_sql('tg', 'th')}, 5) + 0.0 AS gain FROM hist JOIN tot USING (node) WHERE h >= 1 AND th - h >= 1")
def split_onehot(spark, sf_dir):
    return splits.onehot_scan(*hist_of(binned(spark, sf_dir))).where("valid").select("node", "feature", "bin", (F.round("gain", 5) + 0.0).alias("gain"))


@query("split_scan_categorical", f"""WITH {BINNED}, o AS (SELECT node, feature, bin, tg, th, sum(g) OVER w AS gr, sum(h) OVER w AS hr FROM hist JOIN tot USING (node) WINDOW w AS (PARTITION BY node, feature ORDER BY -g / (h + 1), bin ROWS UNBOUNDED PRECEDING))
    SELECT node, feature, bin, round({gain_sql('(tg - gr)', '(th - hr)')} + {gain_sql('gr', 'hr')} - {gain_sql('tg', 'th')}, 5) + 0.0 AS gain FROM o WHERE hr >= 1 AND th - hr >= 1""")
def split_scan_categorical(spark, sf_dir):
    return splits.category_scan(*hist_of(binned(spark, sf_dir))).where("valid").select("node", "feature", "bin", (F.round("gain", 5) + 0.0).alias("gain"))


@query("split_multi_target", f"""WITH {BINNED}, a AS (SELECT b0 AS bin, sum(g) AS g, sum(h) AS h, sum(g2) AS g2, sum(h2) AS h2 FROM x GROUP BY b0), r AS (SELECT bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g2) OVER w AS gl2, sum(h2) OVER w AS hl2, sum(g) OVER () AS tg, sum(h) OVER () AS th, sum(g2) OVER () AS tg2, sum(h2) OVER () AS th2 FROM a WINDOW w AS (ORDER BY bin))
    SELECT bin, round({gain_sql('gl', 'hl')} + {gain_sql('(tg - gl)', '(th - hl)')} - {gain_sql('tg', 'th')} + {gain_sql('gl2', 'hl2')} + {gain_sql('(tg2 - gl2)', '(th2 - hl2)')} - {gain_sql('tg2', 'th2')}, 3) + 0.0 AS gain FROM r WHERE th - hl > 1e-9""")
def split_multi_target(spark, sf_dir):
    df = binned(spark, sf_dir).withColumn("node", F.lit(0))
    parts = [splits.scan(*(x.where("feature = 0") if i == 0 else x for i, x in enumerate(hist_of(df, g, h)))).where("not default_left and hr > 1e-9").select("bin", "gain") for g, h in (("g", "h"), ("g2", "h2"))]
    return parts[0].unionByName(parts[1]).groupBy("bin").agg((F.round(F.sum("gain"), 3) + 0.0).alias("gain"))


@query("exact_split", f"""WITH {BINNED}, v AS (SELECT DISTINCT node, b0 + 1 AS v FROM x), m AS (SELECT node, v, (v + lead(v) OVER (PARTITION BY node ORDER BY v)) / 2.0::DOUBLE AS cut FROM v),
    c AS (SELECT m.node, cut, sum(CASE WHEN b0 + 1 < cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN b0 + 1 < cut THEN h ELSE 0 END) AS hl, sum(g) AS tg, sum(h) AS th FROM m JOIN x ON x.node = m.node WHERE cut IS NOT NULL GROUP BY ALL)
    SELECT node, cut, round({gain_sql('gl', 'hl')} + {gain_sql('(tg - gl)', '(th - hl)')} - {gain_sql('tg', 'th')}, 5) + 0.0 AS gain FROM c""")
def exact_split(spark, sf_dir):
    from pyspark.sql import Window

    df = binned(spark, sf_dir)
    hist, totals = hist_of(df)
    found = splits.scan(hist.where("feature = 0"), totals).where("not default_left")
    nxt = F.lead("bin").over(Window.partitionBy("node").orderBy("bin"))
    return found.withColumn("cut", (F.col("bin") + 1 + nxt + 1) / 2.0).where("cut is not null").select("node", "cut", (F.round("gain", 5) + 0.0).alias("gain"))


@query("partition_rows", f"WITH {BINNED} SELECT row_id, CASE WHEN b1 < 0 THEN 2 WHEN b1 <= 3 THEN 1 ELSE 2 END AS node FROM x")
def partition_rows(spark, sf_dir):
    return binned(spark, sf_dir).select("row_id", F.when(F.col("b1") < 0, 2).when(F.col("b1") <= 3, 1).otherwise(2).alias("node"))


@query("expand_validity", f"WITH {_SCAN} SELECT node, count(*) AS n FROM d WHERE valid AND gain > 1e-6 AND gain >= 0.5 GROUP BY node")
def expand_validity(spark, sf_dir):
    return splits.scan(*hist_of(binned(spark, sf_dir))).where("valid and gain > 1e-6 and gain >= 0.5").groupBy("node").agg(F.count("*").alias("n"))


@query("linear_step", f"WITH {ORDERS} SELECT round(-sum(s - yr) / count(*), 6) AS bias, round(sum((s - yr) * prio), 3) AS g, CAST(sum(prio * prio) AS DOUBLE) AS h FROM b")
def linear_step(spark, sf_dir):
    from boostlake.functions.objectives import objective
    from boostlake.operators.linear import moments

    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yr")).withColumn("x", F.array(F.col("prio").cast("float")))
    a, b, _ = moments(objective("reg:squarederror").gradient(df), 1, 1)
    return spark.createDataFrame([(round(float(-b[0, 1] / a[0, 1, 1]), 6), round(float(b[0, 0]), 3), float(a[0, 0, 0]))], "bias double, g double, h double")


@query("mvs_threshold", f"WITH {ORDERS}, r AS (SELECT sqrt((s - yr) * (s - yr) * w * w + 0.1 * w * w) AS r FROM b), o AS (SELECT r, sum(r) OVER (ORDER BY r) AS c, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n, lead(r) OVER (ORDER BY r) AS nxt FROM r) SELECT round(min(c / (0.5 * n - (n - k))), 5) AS u FROM o WHERE 0.5 * n - (n - k) > 0 AND c / (0.5 * n - (n - k)) > r AND (nxt IS NULL OR c / (0.5 * n - (n - k)) <= nxt)")
def mvs_threshold(spark, sf_dir):
    from boostlake.functions.objectives import Frame, objective
    from boostlake.train import mvs_threshold as solve

    df = orders(spark, sf_dir).withColumn("margin", F.array("s")).withColumn("label", F.col("yr"))
    return spark.createDataFrame([(round(solve(objective("reg:squarederror").gradient(df, Frame(weight="w")), 0.5), 5),)], "u double")


