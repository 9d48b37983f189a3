"""Forest walks over Arrow batches with the model broadcast: values, margins, leaves and attributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.functions.objectives import objective
from boostlake.model import Model, Tree
from boostlake.operators import shap
from boostlake.operators.linear import contributions as linear_contributions

#: Nodes of a forest that is written as CASE expressions; larger ones run as Arrow batches.
CASE_NODES = 100


def margin_of(model: Model, x: np.ndarray, trees: range | None = None, start: np.ndarray | None = None, base: bool = True) -> np.ndarray:
    """Margins of a float32 matrix, rows x groups, in float32."""
    obj = objective(model.objective, {**model.params, "num_class": model.num_class})
    out = np.zeros((len(x), model.groups), np.float32)
    if start is not None:
        out[:] = start
    elif base:
        out[:] = np.array([obj.to_margin(b) for b in model.base_score], np.float32)
    if model.booster == "gblinear":
        return out + (np.nan_to_num(x.astype(np.float64), nan=0.0) @ model.weights[:-1] + model.weights[-1]).astype(np.float32)
    for i in trees if trees is not None else range(len(model.trees)):
        t, w = model.trees[i], np.float32(model.tree_weight(i))
        values = t.leaf[t.leaves(x)] * w
        if values.shape[1] > 1:
            out += values
        else:
            out[:, model.tree_info[i]] += values[:, 0]
    return out


def predict(model: Model, df: DataFrame, output: str = "value", begin: int = 0, end: int = 0, trees: range | None = None, add_to: str | None = None, x: str = "x", strict_shape: bool = False) -> DataFrame:
    """``df`` (with x, an array of float, null or NaN where missing) and a ``prediction``.

    output: value, margin, leaf, contribs, approx_contribs, interactions or approx_interactions. value is an array, one
    entry per output after the objective's transformation; attributions are flat arrays, groups x (features + 1) [x (features
    + 1)]. With ``strict_shape`` they are nested by their dimensions (see ``shape_of``), for every model alike. A base_margin column replaces the base score of margins and values; ``add_to`` names a margin to add to.
    """
    if output not in ("value", "margin", "leaf", "contribs", "approx_contribs", "interactions", "approx_interactions"):
        raise ValueError(f"unknown output {output}")
    if model.booster == "gblinear" and output in ("leaf", "interactions", "approx_interactions"):
        raise ValueError(f"a linear model gives no {output}")
    if output == "leaf" and begin:
        raise ValueError("leaves need rounds from 0")
    chosen = trees if trees is not None else (model.tree_range(begin, end) if model.booster != "gblinear" else None)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != "prediction"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in names]).schema)
    m = model.num_feature
    from_margin = add_to or ("base_margin" if "base_margin" in names and output in ("value", "margin") else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            n = b.num_rows
            flat = b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            width = len(flat) // n if n else m
            xs = flat.reshape(n, width)
            if width < m:
                xs = np.hstack((xs, np.full((n, m - width), np.nan, np.float32)))
            if output in ("value", "margin"):
                start = None
                if from_margin:
                    col = b.column(from_margin)
                    start = np.asarray(col.flatten(), np.float32).reshape(n, -1) if pa.types.is_list(col.type) else np.asarray(col, np.float32)[:, None]
                out = margin_of(own, xs, chosen, start).astype(np.float64)
            elif output == "leaf":
                out = np.stack([own.trees[i].leaves(xs) for i in chosen], axis=1).astype(np.float64) if len(chosen) else np.zeros((n, 0))
            else:
                out = attributions(own, xs, output, chosen).reshape(n, -1)
            k = out.shape[1]
            packed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), packed], names=[*names, "prediction"])

    out = df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{fields}, prediction array<double>")
    if output == "value":
        obj = objective(model.objective, {**model.params, "num_class": model.num_class})
        return out.withColumn("prediction", F.array(*obj.transform([F.col("prediction")[i] for i in range(model.groups)])))
    return out.withColumn("prediction", F.expr(_nested("prediction", shape_of(model, output, begin, end)))) if strict_shape else out


def shape_of(model: Model, output: str, begin: int = 0, end: int = 0) -> tuple[int, ...]:
    """Dimensions of a row's prediction: groups; groups x (features + 1) [x (features + 1)]; of leaves rounds x groups x
    parallel trees."""
    if output in ("value", "margin"):
        return (model.groups,)
    if output == "leaf":
        trees = len(model.tree_range(begin, end))
        rounds = (end or model.rounds) - begin
        per = trees // max(rounds, 1)
        return (rounds, max(per // model.parallel, 1), model.parallel)
    m = model.num_feature + 1
    return (model.groups, m) if "contribs" in output else (model.groups, m, m)


def _nested(flat: str, shape: tuple[int, ...], level: int = 0) -> str:
    """SQL of a flat array cut into arrays of the dimensions."""
    if len(shape) < 2:
        return flat
    inner = int(np.prod(shape[1:]))
    part = f"slice({flat}, i{level} * {inner} + 1, {inner})"
    if not shape[0] * inner:
        return flat
    return f"transform(sequence(0, {shape[0] - 1}), i{level} -> {_nested(part, shape[1:], level + 1)})"


def inplace_predict(model: Model, df: DataFrame, features: list[str], output: str = "value") -> DataFrame:
    """Predict from feature columns as they are: their number must be the model's, base margins aren't used."""
    if len(features) != model.num_feature:
        raise ValueError(f"{len(features)} columns for {model.num_feature} features")
    if model.booster == "gblinear":
        raise ValueError("in-place prediction is for trees")
    rows = df.drop("base_margin", "x").withColumn("x", F.array(*[F.col(f"`{c}`").cast("float") for c in features]))
    return predict(model, rows, output).drop("x")


def attributions(model: Model, x: np.ndarray, output: str, trees: range | None) -> np.ndarray:
    """Contributions (rows, groups, m + 1) or interactions (rows, groups, m + 1, m + 1)."""
    m, k = model.num_feature, model.groups
    obj = objective(model.objective, {**model.params, "num_class": model.num_class})
    base = np.array([obj.to_margin(b) for b in model.base_score])
    if model.booster == "gblinear":
        return linear_contributions(x, model.weights, base[0])
    two = "interactions" in output
    out = np.zeros((len(x), k, m + 1, m + 1) if two else (len(x), k, m + 1))
    for i in trees if trees is not None else range(len(model.trees)):
        t, w = model.trees[i], model.tree_weight(i)
        groups = range(k) if t.leaf.shape[1] > 1 else [model.tree_info[i]]
        for c, g in enumerate(groups):
            if output == "contribs":
                out[:, g] += w * shap.exact(t, x, m, c)
            elif output == "approx_contribs":
                out[:, g] += w * shap.approximate(t, x, m, c)
            elif output == "interactions":
                out[:, g] += w * shap.interactions(t, x, m, c)
            else:  # on and off runs are the same, so only the diagonal is left
                at = np.arange(m + 1)
                out[:, g, at, at] += w * shap.approximate(t, x, m, c)
    if two:
        out[:, :, m, m] += base
    else:
        out[:, :, m] += base
    return out


def case_expression(t: Tree, features: list[str], leaf_id: bool = False, column: int = 0) -> Column:
    """A small tree as nested CASE; null features are missing."""

    def at(i: int) -> Column:
        if t.left[i] < 0:
            return F.lit(i) if leaf_id else F.lit(float(t.leaf[i, column]))
        v, a, b = F.col(f"`{features[t.feature[i]]}`").cast("float"), at(int(t.left[i])), at(int(t.right[i]))
        test = ~v.cast("int").isin([int(c) for c in t.categories[i]]) if i in t.categories else v < F.lit(float(t.cond[i])).cast("float")
        return F.when(v.isNull() | F.isnan(v), a if t.default_left[i] else b).when(test, a).otherwise(b)

    return at(0)


def sql_margin(model: Model, features: list[str]) -> list[Column]:
    """Margins of a small forest as column expressions, one per group."""
    if sum(t.n for t in model.trees) > CASE_NODES:
        raise ValueError("the forest is too large for CASE expressions; use predict")
    obj = objective(model.objective, {**model.params, "num_class": model.num_class})
    out = [F.lit(float(obj.to_margin(b))) for b in model.base_score]
    for i, t in enumerate(model.trees):
        out[model.tree_info[i]] = out[model.tree_info[i]] + model.tree_weight(i) * case_expression(t, features)
    return out
