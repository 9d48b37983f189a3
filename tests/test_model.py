"""Models: interchange, dumps, importance, slices, attribution identities."""

import json

import numpy as np
import pytest

from boostlake.model import Model, Tree, general, number, parse_eval, read_feature_map, ubj_bytes, ubj_value
from boostlake.operators import shap
from boostlake.operators.predict import attributions, margin_of
from boostlake.operators.refresh import prune
from boostlake.operators.splits import TreeParams
from boostlake.plans.model_queries import forest


def random_tree(rng, features=4, splits=6):
    t = Tree.root()
    t.sum_hess[0] = 100
    leaves = [0]
    for _ in range(splits):
        n = leaves.pop(rng.integers(len(leaves)))
        share = rng.uniform(0.2, 0.8)
        cats = np.array([0, 2]) if rng.random() < 0.2 else None
        leaves += t.expand(n, int(rng.integers(features)), float(rng.uniform(0.5, 2.5)), bool(rng.integers(2)), 1.0, rng.normal(size=(2, 1)), (float(t.sum_hess[n] * share), float(t.sum_hess[n] * (1 - share))), cats)
    return t


def sample(rng, n=50, features=4):
    x = rng.integers(0, 4, (n, features)).astype(np.float32)
    x[rng.random(x.shape) < 0.2] = np.nan
    return x


def test_round_trips():
    m = forest()
    m.attributes["best_iteration"] = "2"
    for kind in ("json", "ubj"):
        again = Model.load(m.save(kind))
        assert all(a.equal(b) for a, b in zip(m.trees, again.trees, strict=True))
        assert again.attributes == m.attributes and again.save() == m.save()
    with pytest.raises(ValueError):
        Model.load(b"binf....")
    with pytest.raises(ValueError):
        m.save("xml")


def test_vector_leaves_round_trip():
    t = Tree.root(2)
    t.expand(0, 1, 3.0, True, 1.0, np.array([[1, 2], [3, 4]]), (1, 1))
    m = Model("reg:squarederror", num_feature=2, num_target=2, base_score=[0.0, 0.0], trees=[t], tree_info=[0], indptr=[0, 1])
    assert Model.load(m.save("ubj")).trees[0].equal(t)


def test_numbers():
    assert number(300.0) == "3E2" and number(0.0) == "0E0" and number(-0.065) == "-6.5E-2"
    assert general(0.489981771) == "0.489981771" and general(300) == "300"


def test_ubj_values():
    x = {"a": [1, 2.5, "x", True, False, None], "b": np.arange(3, dtype=np.int32), "c": {}}
    assert ubj_value(ubj_bytes(x)) == {"a": [1, 2.5, "x", True, False, None], "b": [0, 1, 2], "c": {}}


def test_text_dump():
    lines = forest().dump("text", True)[0].split("\n")
    assert lines[0] == "0:[prio<3] yes=1,no=2,missing=1,gain=10,cover=100"
    assert lines[1].startswith("\t1:[price<150000] yes=3,no=4,missing=4")
    assert json.loads(forest().dump("json", True)[0])["children"][0]["nodeid"] == 1
    assert forest().dump("dot")[0].startswith("digraph {")
    with pytest.raises(ValueError):
        forest().dump("xml")


def test_feature_map():
    assert read_feature_map("0 a q\n1 b i\n") == [("a", "q"), ("b", "i")]
    with pytest.raises(ValueError):
        read_feature_map("0 a zz")


def test_slices_and_ranges():
    m = forest()
    assert m.slice(0, 3, 2).rounds == 2 and m.slice(1).tree_info == [0, 0]
    with pytest.raises(IndexError):
        m.slice(2, 9)
    with pytest.raises(ValueError):
        m.tree_range(3, 2)


def test_importance():
    assert forest().importance("weight") == {"price": 2.0, "prio": 2.0, "days": 2.0}
    assert forest().importance("total_gain") == {"price": 14.0, "prio": 14.0, "days": 14.0}


def test_eval_line():
    assert parse_eval("[7]\ttrain-rmse:0.25\tmy-set-auc:0.5", ["train", "my-set"]) == {"train": {"rmse": 0.25}, "my-set": {"auc": 0.5}}


@pytest.mark.parametrize("seed", range(8))
def test_attributions_add_up(seed):
    rng = np.random.default_rng(seed)
    t, x = random_tree(rng), sample(rng)
    value = t.leaf[t.leaves(x), 0]
    phi = shap.exact(t, x, 4)
    assert np.allclose(phi.sum(axis=1), value, atol=1e-6)
    both = shap.interactions(t, x, 4)
    assert np.allclose(both.sum(axis=2), phi, atol=1e-6) and np.allclose(both, both.transpose(0, 2, 1), atol=1e-9)
    assert np.allclose(shap.approximate(t, x, 4).sum(axis=1), value, atol=1e-6)


def test_shapley_by_coalitions():
    """Against the definition, by all coalitions of features."""
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(3)
    t, x = random_tree(rng, 3, 4), sample(rng, 10, 3)

    def value(row, known, node=0):
        if t.left[node] < 0:
            return float(t.leaf[node, 0])
        a, b, f = int(t.left[node]), int(t.right[node]), int(t.feature[node])
        if f in known:
            return value(row, known, a if shap._follows(t, node, row[None])[0] else b)
        return (value(row, known, a) * t.sum_hess[a] + value(row, known, b) * t.sum_hess[b]) / t.sum_hess[node]

    phi = shap.exact(t, x, 3)
    for r, row in enumerate(x):
        for f in range(3):
            rest = [i for i in range(3) if i != f]
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value(row, {*s, f}) - value(row, set(s))) for k in range(3) for s in combinations(rest, k))
            assert abs(phi[r, f] - want) < 1e-6


def test_margins_and_attributions_of_models():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 4e5, 40), rng.integers(1, 6, 40), rng.uniform(0, 2500, 40)]).astype(np.float32)
    x[::5, 2] = np.nan
    assert np.allclose(attributions(forest(), x, "contribs", None).sum(axis=2)[:, 0], margin_of(forest(), x)[:, 0], atol=1e-5)


def test_prune():
    m = prune(forest(), TreeParams(min_split_loss=5))
    assert [t.n for t in m.trees] == [3, 3, 3]
    assert [t.n for t in prune(forest(), TreeParams(min_split_loss=50)).trees] == [1, 1, 1]
