"""Sources: text formats, locations, matrices, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostlake.operators import prep
from boostlake.plans.model_queries import FEATURES, forest
from boostlake.sources import matrix
from boostlake.sources.text import parse_csv, parse_libsvm, parse_location, read_text
from boostlake.streaming.scoring import refresh_stream, score_stream


def lines(spark, *text):
    return spark.createDataFrame(list(enumerate(text)), "row_id long, value string")


def test_libsvm(spark):
    out = parse_libsvm(lines(spark, "1:0.5 qid:3 0:1.5 4 # note", "", "0 1:2")).orderBy("row_id").collect()
    assert [(r.label, r.weight, r.qid) for r in out] == [(1.0, 0.5, 3), (0.0, None, None)]
    assert [tuple(e) for e in out[0].entries] == [(0, 1.5), (4, 1.0)]
    assert parse_libsvm(lines(spark, "0 1:2"), -1).first().entries[0]["index"] == 0
    assert parse_libsvm(lines(spark, "0 0:2"), -1).first().entries[0]["index"] == 0


def test_csv(spark):
    out = parse_csv(lines(spark, "1,0.5,2", "x,,3"), label_column=0).orderBy("row_id").collect()
    assert [(r.label, r.x) for r in out] == [(1.0, [0.5, 2.0]), (0.0, [None, 3.0])]
    with pytest.raises(Exception, match="delimiter"):
        parse_csv(lines(spark, "1;2")).collect()


def test_locations(spark, tmp_path):
    assert parse_location("a/b?format=csv&label_column=1").options == {"label_column": "1"}
    for bad in ("a", "a?format=xml", "a#b?format=csv", "a#b#c?format=csv"):
        with pytest.raises(ValueError):
            parse_location(bad)
    (tmp_path / "x.txt").write_text("1 0:2\n0 1:3\n")
    assert read_text(spark, f"{tmp_path}/x.txt?format=auto").count() == 2


def test_matrices(spark, tmp_path):
    d = matrix.from_arrays(spark, np.array([[1, np.nan, 3], [4, 5, 6]]))
    assert d.select(F.sum(F.size(F.filter("x", lambda v: v.isNotNull())))).first()[0] == 5
    assert matrix.from_arrays(spark, np.array([[1, -1], [3, -1]]), -1.0).select(F.sum(F.size(F.filter("x", lambda v: v.isNotNull())))).first()[0] == 2
    csr = matrix.from_csr(spark, [0, 2, 3], [0, 2, 2], [1, 2, 3], 3)
    assert matrix.widen(csr, 3).collect()[0].x == [1.0, None, 2.0]
    assert matrix.from_csc(spark, [0, 1, 2], [0, 1], [5, 6]).count() == 2
    with pytest.raises(ValueError):
        matrix.from_csr(spark, [0, 1], [7], [1], 3)
    with pytest.raises(Exception, match="infinite"):
        spark.createDataFrame([(float("inf"),)], "a float").select(matrix.checked(F.col("a"))).collect()
    matrix.save(csr, str(tmp_path / "m"), ["a", "b", "c"])
    again, note = matrix.load(spark, str(tmp_path / "m"))
    assert again.count() == 2 and note["feature_names"] == ["a", "b", "c"]


def test_recode_rejects_unknown(spark):
    known = spark.createDataFrame([("a", 0)], "value string, code int")
    with pytest.raises(Exception, match="unknown category"):
        prep.recode(spark.createDataFrame([("b",)], "f string"), "f", known).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i * 1000), i % 5 + 1, float(i * 10), float(i % 2)) for i in range(50)], "row_id long, price double, prio int, days double, label double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = score_stream(stream, forest(), FEATURES, lambda df, i: seen.append(df.count()), str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 50
    q, newest = refresh_stream(stream, forest(), FEATURES, "label", str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert newest().trees[0].sum_hess[0] != forest().trees[0].sum_hess[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
