"""Single rounds, snapshots, configuration, callbacks, grid search, validation and output shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostlake.learner import Checkpoint, Learner, SaveBest, build_info, get_config, grid_search, set_config, train_with, version
from boostlake.operators.cuts import Cuts, bins_matrix, summaries
from boostlake.operators.predict import predict, shape_of
from boostlake.operators.prep import query_runs
from boostlake.session import is_local, steps
from boostlake.train import Data, train


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=300) / 10
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 0), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, up int, kind int")


PARAMS = {"max_depth": 3, "eta": 0.4, "seed": 3, "subsample": 0.8}
NAMES = ["a", "b", "c"]


def same(a, b):
    return a.rounds == b.rounds and all(x.equal(y) for x, y in zip(a.trees, b.trees, strict=True))


def test_rounds_one_by_one(frame):
    d = Data(frame, NAMES)
    whole = train(PARAMS, d, 3, {"train": d})
    own = Learner(PARAMS)
    assert [own.update(d) for _ in range(3)] == [0, 1, 2] and same(own.model, whole.model)
    line, values = own.evaluate({"train": d})
    assert line.startswith("[2]\ttrain-rmse:") and abs(values["train"]["rmse"] - whole.history["train"]["rmse"][-1]) < 1e-6


def test_snapshot_goes_on(frame):
    d = Data(frame, NAMES)
    whole = Learner(PARAMS)
    for _ in range(4):
        whole.update(d)
    half = Learner(PARAMS)
    half.update(d), half.update(d)
    half.set_attr(note="x", gone="y")
    half.set_attr(gone=None)
    for kind in ("ubj", "json"):
        again = Learner.restore(half.snapshot(kind))
        assert again.attributes() == {"note": "x"} and again.attr("gone") is None and again.config() == half.config()
        again.update(d), again.update(d)
        assert same(again.model, whole.model)
    half.reset()
    half.update(d), half.update(d)
    assert same(half.model, whole.model)


def test_boost_on_given_gradients(frame):
    d = Data(frame, NAMES)
    given = lambda df: df.withColumn("g", F.array(F.col("margin")[0] - F.col("label"))).withColumn("h", F.array(F.lit(1.0)))
    a, b = Learner(PARAMS), Learner(PARAMS)
    a.update(d), a.update(d)
    b.boost(d, given), b.boost(d, given)
    assert same(a.model, b.model)


def test_callbacks_and_grid(frame):
    d = Data(frame, NAMES)
    kept = {}
    own = Learner({**PARAMS, "eta": 1.9})
    best = SaveBest()
    history = train_with(own, d, 4, {"train": d}, [best, Checkpoint(kept.__setitem__, 2)])
    scores = history["train"]["rmse"]
    assert len(scores) == 4 and sorted(kept) == [1, 3] and Learner.restore(kept[1]).model.rounds == 2
    assert own.model.rounds == scores.index(min(scores)) + 1 and own.attr("best_iteration") == str(scores.index(min(scores)))
    found = grid_search({"eta": 0.5}, {"max_depth": [1, 3]}, d, 2, 2)
    assert [r["params"] for r in found] == [{"max_depth": 3}, {"max_depth": 1}] and found[0]["score"] < found[1]["score"]


def test_settings():
    assert version() == (3, 5, 0) and build_info()["engine"] == "spark"
    set_config(verbosity=2)
    assert get_config()["verbosity"] == 2
    set_config(verbosity=1)
    with pytest.raises(ValueError):
        set_config(nothing=1)


@pytest.mark.parametrize(("params", "label", "roles", "wrong"), [
    ({"objective": "binary:logistic"}, "kind", {}, "domain"), ({}, "hole", {}, "finite"), ({}, "label", {"weight": "minus"}, "weights"),
    ({"objective": "rank:ndcg"}, "kind", {"qid": "gap"}, "query ids"), ({"objective": "survival:aft"}, "label", {"lower": "up", "upper": "minus"}, "bounds"),
])
def test_validation(frame, params, label, roles, wrong):
    df = frame.withColumn("hole", F.when(F.col("row_id") != 7, F.col("label"))).withColumn("minus", F.lit(-1.0)).withColumn("gap", F.when(F.col("row_id") > 3, F.col("kind")))
    with pytest.raises(ValueError, match=wrong):
        train(params, Data(df, NAMES, label, **roles), 1)


def test_shapes(frame):
    d = Data(frame.limit(20), NAMES, "kind")
    model = train({"objective": "multi:softprob", "num_class": 3, "max_depth": 2, "num_parallel_tree": 2}, Data(frame, NAMES, "kind"), 2).model
    for output, shape in (("margin", (3,)), ("contribs", (3, 4)), ("interactions", (3, 4, 4)), ("leaf", (2, 3, 2))):
        flat = {r.row_id: r.prediction for r in predict(model, d.plain(), output).collect()}
        nested = {r.row_id: r.prediction for r in predict(model, d.plain(), output, strict_shape=True).collect()}
        assert shape_of(model, output) == shape
        for k, v in flat.items():
            assert np.array(nested[k]).shape == shape and np.array_equal(np.array(nested[k]).ravel(), np.array(v))


def test_categories_out_of_range():
    cuts = Cuts([np.arange(4, dtype=np.float32)], [True])
    assert bins_matrix(np.array([[3], [np.nan]], np.float32), cuts).tolist() == [[3], [-1]]
    for bad in (-2, 1.7):
        with pytest.raises(ValueError):
            bins_matrix(np.array([[bad]], np.float32), cuts)


def test_queries_in_order(spark):
    good = spark.createDataFrame([(0, 5), (1, 5), (2, 3)], "row_id long, qid long")
    assert sorted(tuple(r) for r in query_runs(good, "qid", "row_id", ordered=True).collect()) == [(3, 2, 1), (5, 0, 2)]
    with pytest.raises(Exception, match="query comes back"):
        query_runs(good.union(spark.createDataFrame([(3, 5)], good.schema)), "qid", "row_id", ordered=True).collect()


def test_summaries_in_steps(spark, frame, monkeypatch):
    from boostlake.operators import cuts

    want = {r.feature: (r["values"], r["weights"]) for r in summaries(frame, NAMES).collect()}
    monkeypatch.setattr(cuts, "steps", lambda df: 2)
    got = {r.feature: (r["values"], r["weights"]) for r in summaries(frame.repartition(9), NAMES).collect()}
    assert got == want and steps(frame) >= 0 and is_local("local[4]") and not is_local("local-cluster[2,1,1024]")


def test_eval_margins_are_stored(frame, monkeypatch):
    import boostlake.train as t

    monkeypatch.setattr(t, "STORE_EVERY", 2)
    d = Data(frame, NAMES)
    a = train(PARAMS, d, 5, {"train": d}).history["train"]["rmse"]
    monkeypatch.setattr(t, "STORE_EVERY", 100)
    assert np.allclose(a, train(PARAMS, d, 5, {"train": d}).history["train"]["rmse"])
