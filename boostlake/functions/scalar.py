"""Scalar functions as Column expressions; all but erf and lgamma stay in generated code."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-16


def lit(x: float) -> Column:
    return F.lit(float(x))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), with the exponent held under 88.7 and a guard against division by zero."""
    return 1.0 / (F.exp(F.least(-x, lit(88.7))) + 1.0 + lit(EPS))


def logit(p: Column) -> Column:
    return -F.log(1.0 / p - 1.0)


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def argmax(xs: list[Column]) -> Column:
    """Place of the first maximum, from 0."""
    a = F.array(*xs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(xs: list[Column]) -> Column:
    top = F.greatest(*xs)
    parts = [F.exp(x - top) for x in xs]
    return top + F.log(sum(parts[1:], parts[0]))


def softplus(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def inverse_softplus(y: Column) -> Column:
    held = F.greatest(y, lit(1e-6))
    return held + F.log(-F.expm1(-held))


def fmax(a: Column, b: Column) -> Column:
    """The larger one; of a NaN and a number, the number."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def close_to(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) < eps


def soft_threshold(x: Column, alpha: float) -> Column:
    """Towards zero by alpha."""
    return F.when(x > alpha, x - alpha).when(x < -alpha, x + alpha).otherwise(lit(0))


def dcg_gain(rel: Column, exponential: bool = True) -> Column:
    return F.pow(lit(2), rel) - 1.0 if exponential else rel


def dcg_discount(place: Column) -> Column:
    """Discount of a place counted from 0."""
    return 1.0 / F.log2(place + 2.0)


def leaf_weight(g: Column, h: Column, reg_lambda: float = 1.0, reg_alpha: float = 0.0, max_delta_step: float = 0.0) -> Column:
    w = -soft_threshold(g, reg_alpha) / (h + reg_lambda)
    if max_delta_step:
        w = F.greatest(F.least(w, lit(max_delta_step)), lit(-max_delta_step))
    return F.when(h > 0, w).otherwise(lit(0))


def gain_of_weight(g: Column, h: Column, w: Column, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> Column:
    return -(2.0 * g * w + (h + reg_lambda) * w * w + 2.0 * reg_alpha * F.abs(w))


def gain(g: Column, h: Column, reg_lambda: float = 1.0, reg_alpha: float = 0.0, max_delta_step: float = 0.0) -> Column:
    """Gain of a node at its best weight; 0 without hessian."""
    w = leaf_weight(g, h, reg_lambda, reg_alpha, max_delta_step)
    return F.when(h > 0, gain_of_weight(g, h, w, reg_lambda, reg_alpha)).otherwise(lit(0))


def coordinate_delta(g: Column, h: Column, w: Column, reg_alpha: float, reg_lambda: float) -> Column:
    """Step of one linear weight under elastic-net penalties."""
    g2, h2 = g + reg_lambda * w, h + reg_lambda
    target = w - g2 / h2
    step = F.when(target >= 0, F.greatest(-(g2 + reg_alpha) / h2, -w)).otherwise(F.least(-(g2 - reg_alpha) / h2, -w))
    return F.when(h < 1e-5, lit(0)).otherwise(step)


def erf_kernel(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.erf(v) for v in x.to_pylist()], pa.float64())


def lgamma_kernel(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.lgamma(v) for v in x.to_pylist()], pa.float64())


def erf(x: Column) -> Column:
    return F.arrow_udf(erf_kernel, "double")(x)


def lgamma(x: Column) -> Column:
    return F.arrow_udf(lgamma_kernel, "double")(x)


def aft_parts(z: Column, distribution: str) -> dict[str, Column]:
    """pdf, cdf and the first two derivatives of the pdf at z."""
    if distribution == "normal":
        pdf = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
        return {"pdf": pdf, "cdf": 0.5 * (1.0 + erf(z / math.sqrt(2))), "grad": -z * pdf, "hess": (z * z - 1.0) * pdf}
    w = F.exp(z)
    if distribution == "logistic":
        one = 1.0 + w
        big = w > 1e150
        pdf = F.when(big, lit(0)).otherwise(w / (one * one))
        return {"pdf": pdf, "cdf": F.when(big, lit(1)).otherwise(w / one), "grad": F.when(big, lit(0)).otherwise(pdf * (1.0 - w) / one), "hess": F.when(big, lit(0)).otherwise(pdf * (w * w - 4.0 * w + 1.0) / (one * one))}
    if distribution == "extreme":
        e = F.exp(-w)
        big = w > 1e150
        pdf = F.when(big, lit(0)).otherwise(w * e)
        return {"pdf": pdf, "cdf": 1.0 - e, "grad": F.when(big, lit(0)).otherwise((1.0 - w) * pdf), "hess": F.when(big, lit(0)).otherwise((w * w - 3.0 * w + 1.0) * pdf)}
    raise ValueError(f"unknown distribution {distribution}")
