"""Cut points, their sketch, and bins.

Cuts of a feature are upper bounds of its bins. Summaries (distinct values with weights) are built per partition, pruned
to a size when they outgrow it, and merged in as many steps as the tasks need, so no task sees more than FAN_IN summaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlake.session import FAN_IN, steps


@dataclass
class Cuts:
    """values[f]: ascending float32 cuts of feature f; categorical features have their codes 0..max. With ``exact`` bins
    are only stretches in which the exact method looks for cuts, and binned frames hold the values themselves."""

    values: list[np.ndarray]
    categorical: list[bool]
    exact: bool = False

    @property
    def kind(self) -> str:
        """Type of the numbers in the bins of a frame."""
        if self.exact:
            return "<f4"
        return "<i2" if max(map(len, self.values), default=0) <= np.iinfo(np.int16).max else "<i4"

    def rows(self) -> list[tuple[int, int, float, bool]]:
        """(feature, bin, cut, is_cat)."""
        return [(f, b, float(c), self.categorical[f]) for f, v in enumerate(self.values) for b, c in enumerate(v)]


def past_last(value: float) -> np.float32:
    """The closing cut after the largest value."""
    v = np.float32(value)
    return np.float32(v + (abs(v) + np.float32(1e-5)))


def choose(values: np.ndarray, weights: np.ndarray, max_bin: int) -> np.ndarray:
    """Cuts of one feature from ascending distinct values and their weights.

    With at most ``max_bin`` values each but the smallest is a cut; else cuts are the values at evenly spaced
    ranks. One more closes the last bin; without values it is 1e-5.
    """
    n = len(values)
    if not n:
        return np.array([1e-5], np.float32)
    if n <= max_bin:
        return np.concatenate((values[1:], [past_last(values[-1])])).astype(np.float32)
    rmax = np.cumsum(weights, dtype=np.float64)
    rmin = rmax - weights
    out: list[float] = []
    q, last = 0, None
    for i in range(1, max_bin):
        r = i * rmax[-1] / max_bin
        while q < n - 2 and 2 * r >= rmin[q + 1] + rmax[q + 1]:
            q += 1
        v = values[q] if 2 * r < (rmin[q] + weights[q]) + (rmax[q + 1] - weights[q + 1]) else values[q + 1]
        low = values[0] if last is None else last
        if v <= low:
            k = np.searchsorted(values, low, side="right")
            if k >= n:
                break
            v = values[k]
        out.append(v)
        last = v
    return np.concatenate((out, [past_last(values[-1])])).astype(np.float32)


def prune(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A summary of at most ``size`` values with the same total weight; ranks move by at most total / size."""
    if len(values) <= size:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.concatenate(([0], np.searchsorted(upto, np.linspace(0, upto[-1], size)[1:-1]), [len(values) - 1])))
    held = upto[at]
    return values[at], np.diff(np.concatenate(([0], held)))


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of summaries: equal values join."""
    v, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    values, place = np.unique(v, return_inverse=True)
    return values, np.bincount(place, w, len(values))


def summaries(df: DataFrame, features: list[str], weight: Column | None = None, size: int = 4096) -> DataFrame:
    """(feature, values, weights): one summary per feature, exact while it has at most ``size`` distinct values."""
    n = len(features)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.float32), np.zeros(0)) for _ in range(n)]
        for batch in batches:
            w = np.asarray(batch.column(n), np.float64)
            for f in range(n):
                x = np.asarray(batch.column(f).to_numpy(zero_copy_only=False), np.float32)
                ok = ~np.isnan(x)
                held[f] = prune(*merge([held[f], (x[ok], w[ok])]), 2 * size)
        part = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_pydict({"feature": list(range(n)), "part": [part] * n, "values": [v.tolist() for v, _ in held], "weights": [w.tolist() for _, w in held]}, schema=_SUMMARY)

    def join(t: pa.Table) -> pa.Table:
        parts = [(np.array(v, np.float32), np.array(w, np.float64)) for v, w in zip(t.column("values").to_pylist(), t.column("weights").to_pylist(), strict=True)]
        parts.sort(key=lambda p: (len(p[0]), p[0].tobytes(), p[1].tobytes()))
        v, w = prune(*merge(parts), 2 * size)
        return pa.Table.from_pydict({"feature": [t.column("feature")[0].as_py()], "part": t.column("part")[:1].to_pylist(), "values": [v.tolist()], "weights": [w.tolist()]}, schema=_SUMMARY)

    schema = "feature int, part int, values array<float>, weights array<double>"
    rows = df.select(*[F.col(f"`{c}`").cast("float").alias(f"x{i}") for i, c in enumerate(features)], (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    found = rows.mapInArrow(local, schema)
    for _ in range(steps(df)):
        found = found.groupBy("feature", "part").applyInArrow(join, schema).withColumn("part", F.expr(f"part div {FAN_IN}"))
    return found.groupBy("feature").applyInArrow(join, schema).select("feature", "values", "weights")


_SUMMARY = pa.schema([("feature", pa.int32()), ("part", pa.int32()), ("values", pa.list_(pa.float32())), ("weights", pa.list_(pa.float64()))])


def build(df: DataFrame, features: list[str], max_bin: int = 256, categorical: list[bool] | None = None, weight: Column | None = None, size: int | None = None) -> Cuts:
    """Cuts of all features; only summaries of a fixed size reach the driver."""
    cats = categorical or [False] * len(features)
    found: list[np.ndarray] = [np.array([1e-5], np.float32)] * len(features)
    for r in summaries(df, features, weight, size or max(8 * max_bin, 4096)).collect():
        v, w = np.array(r["values"], np.float32), np.array(r["weights"], np.float64)
        if cats[r["feature"]]:
            found[r["feature"]] = np.arange(int(v.max()) + 1 if len(v) else 1, dtype=np.float32)
        else:
            found[r["feature"]] = choose(v, w, max_bin)
    return Cuts(found, cats)


def distinct_cuts(df: DataFrame, column: str) -> DataFrame:
    """(bin, cut) of a column with few distinct values, as a window over the distinct values: every value but the
    smallest, then the closing cut."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("float").alias("v")).distinct()
    order = Window.orderBy("v")  # over distinct values
    nxt = F.lead("v").over(order)
    return values.select((F.row_number().over(order) - 1).alias("bin"), F.coalesce(nxt, (F.col("v") + (F.abs("v") + F.lit(1e-5).cast("float"))).cast("float")).alias("cut"))


def bin_of(x: Column, cuts: list[float]) -> Column:
    """Bin of a value: the first cut above it, at most the last; -1 where missing."""
    held = F.array(*[F.lit(float(c)).cast("float") for c in cuts])
    below = F.size(F.filter(held, lambda c: c <= x.cast("float")))
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(-1)).otherwise(F.least(below, F.lit(len(cuts) - 1))).cast("int")


def bins_matrix(x: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Bins of a float32 matrix; -1 where missing."""
    out = np.full(x.shape, -1, np.int32)
    for f, values in enumerate(cuts.values):
        ok = ~np.isnan(x[:, f])
        if cuts.categorical[f]:
            if (x[ok, f] < 0).any() or (x[ok, f] != np.trunc(x[ok, f])).any():
                raise ValueError(f"feature {f}: codes of categories are whole numbers from 0")
            out[ok, f] = np.minimum(np.searchsorted(values, np.trunc(x[ok, f]), side="left"), len(values) - 1)
        else:
            out[ok, f] = np.minimum(np.searchsorted(values, x[ok, f], side="right"), len(values) - 1)
    return out
