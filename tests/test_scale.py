"""Queries whose faults show only on larger tables than the smallest, against their twins."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boostlake.functions import ranking
from boostlake.functions.objectives import Frame, objective
from boostlake.functions.ranking import lambda_gradients
from boostlake.operators import prep
from boostlake.operators.grow import grow
from boostlake.plans import catalog
from boostlake.train import Data, train

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """A folder with 400 copies of the smallest orders under shifted keys."""
    folder = str(tmp_path_factory.mktemp("larger"))
    source = f"'{SMALL}/orders.parquet'"
    c = duckdb.connect()
    keys, customers = c.execute(f"select max(o_orderkey) + 1, max(o_custkey) + 1 from {source}").fetchone()
    c.execute(f"copy (select * replace (o_orderkey + i * {keys} as o_orderkey, o_custkey + i * {customers} as o_custkey) from range(400) t(i), {source}) to '{folder}/orders.parquet'")
    return folder


def differing(spark, folder, name):
    """Rows of a query that its twin lacks, and the other way round."""
    got, c = catalog.QUERIES[name](spark, folder).toPandas(), duckdb.connect()  # noqa: F841
    c.execute(f"create view orders as select * from '{folder}/orders.parquet'")
    columns = ", ".join(f'"{x}"' for x in got.columns)
    c.execute(f"create table want as select {columns} from ({catalog.ORACLES[name]})")
    c.execute(f"create table told as select {columns} from got")
    return c.execute("from told except all from want").fetchall(), c.execute("from want except all from told").fetchall()


def test_refreshed_gains_are_exact(spark, larger):
    assert differing(spark, larger, "refresh_leaves") == ([], [])


def by_query(spark, sizes, kind, params, weight, kinds="long"):
    """Gradients of queries told by the objective in one frame, and those of each query alone."""
    rng = np.random.default_rng(41)
    queries = rng.permutation(np.repeat(np.arange(len(sizes)), sizes)).tolist()
    rows = [(i, q or None, round(float(rng.normal()), 1), float(rng.integers(0, 2)), 0.5 + q % 3) for i, q in enumerate(queries)]
    df = spark.createDataFrame(rows, "row_id long, qid long, s double, label double, w double").withColumn("margin", F.array("s")).withColumn("qid", F.col("qid").cast(kinds))
    f = Frame(qid="qid", weight="w" if weight else None)
    got = {r["row_id"]: (r["g"][0], r["h"][0]) for r in objective(f"rank:{kind}", params).gradient(df, f).collect()}
    scale = len(sizes) / sum(0.5 + q % 3 for q in range(len(sizes))) if weight else 1.0
    want = {}
    for q in range(len(sizes)):
        own = [r for r in rows if r[1] == (q or None)]
        g, h = lambda_gradients(np.array([r[2] for r in own], np.float32), np.array([r[3] for r in own]), kind, params, own[0][4] * scale if weight else 1.0)
        want |= {r[0]: x for r, x in zip(own, zip(g, h, strict=True), strict=True)}
    return got, want


@pytest.mark.parametrize(("kind", "params", "weight", "kinds"), [("ndcg", {}, True, "long"), ("map", {}, False, "string"), ("pairwise", {"lambdarank_pair_method": "mean"}, True, "double"), ("ndcg", {"lambdarank_num_pair_per_sample": 2}, False, "int")])
def test_queries_across_batches(spark, monkeypatch, kind, params, weight, kinds):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(ranking, "PAIRS", 40)
    try:
        got, want = by_query(spark, [3, 1, 40, 2, 9, 14, 1, 5, 21, 7], kind, params, weight, kinds)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], rtol=1e-12, atol=1e-12) for i in want)


def test_queries_share_calls(spark, larger):
    """Tasks take many queries at once: the plan has no call of Python per query."""
    df = spark.range(10).selectExpr("id as row_id", "id div 2 as qid", "array(double(id)) as margin", "double(id % 2) as label")
    plan = objective("rank:ndcg").gradient(df, Frame(qid="qid"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("name", ["grad_rank_map", "grad_rank_pairwise", "grad_rank_ndcg"])
def test_ranking_twins(spark, larger, name):
    assert differing(spark, larger, name) == ([], [])


def test_pointers_by_stretches(spark, larger, monkeypatch):
    monkeypatch.setattr(prep, "STRETCH", 1 << 12)
    assert differing(spark, larger, "export_csr") == ([], [])
    df = spark.range(100_000).selectExpr("if(id = 7, null, id * 3) as k", "int(id % 5) as n")
    got = prep.group_pointers(df, "k", "n")
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning" in plan and "SinglePartition" not in plan
    rows = sorted(got.collect(), key=lambda r: (r["k"] is not None, r["k"]))
    ends = np.cumsum([7 % 5, *(i % 5 for i in range(100_000) if i != 7)])
    assert [r["end"] for r in rows] == ends.tolist() and [r["start"] for r in rows] == [0, *ends[:-1].tolist()]


def test_approx_moves_no_rows(spark, monkeypatch):
    """Rounds of the approx method bin the rows anew where they lie, and fit as the histogram method does where every value is a bin."""
    rng = np.random.default_rng(17)
    x = rng.integers(0, 20, (400, 2)).astype(float)
    rows = [(i, a, None if i % 9 == 0 else b, a - b * (i % 9 > 0) + rng.normal()) for i, (a, b) in enumerate(x.tolist())]
    d = Data(spark.createDataFrame(rows, "row_id long, a double, b double, label double"), ["a", "b"])
    seen = []
    monkeypatch.setattr("boostlake.train.grow", lambda df, *a, **k: seen.append(df._jdf.queryExecution().analyzed().toString()) or grow(df, *a, **k))
    told = {m: train({"tree_method": m, "max_depth": 3}, d, 3, {"train": d}).history["train"]["rmse"] for m in ("approx", "hist")}
    assert np.allclose(told["approx"], told["hist"], rtol=1e-6) and not any("Join" in plan for plan in seen)
