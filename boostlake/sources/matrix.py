"""Matrix layouts as frames: dense rows, compressed rows and columns, and typed columns with categories."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "array<struct<index:int,fvalue:float>>"


def valid(x: Column, missing: float = float("nan")) -> Column:
    """The value as float, null where it is NaN or the missing mark."""
    v = x.cast("float")
    bad = F.isnan(v) if missing != missing else F.isnan(v) | (v == F.lit(missing).cast("float"))
    return F.when(bad, None).otherwise(v)


def checked(x: Column) -> Column:
    """The value; infinite ones are an error."""
    return F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("a feature holds an infinite value")).cast("float")).otherwise(x)


def dense(df: DataFrame, features: list[str], missing: float = float("nan"), keep: list[str] = ()) -> DataFrame:
    """``df`` with x, an array of float with null for missing values."""
    return df.select(*keep, F.array(*[valid(F.col(f"`{c}`"), missing) for c in features]).alias("x"))


def from_arrays(spark: SparkSession, data: np.ndarray, missing: float = float("nan")) -> DataFrame:
    """row_id and x of a numpy matrix."""
    a = np.asarray(data, np.float32)
    if a.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    return dense(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], ["row_id", *[f"f{j}" for j in range(a.shape[1])]]), [f"f{j}" for j in range(a.shape[1])], missing, ["row_id"])


def from_csr(spark: SparkSession, indptr, indices, values, columns: int = 0) -> DataFrame:
    """row_id and entries of compressed rows; entries that aren't there are missing."""
    rows = [(i, [(int(indices[k]), float(values[k])) for k in range(indptr[i], indptr[i + 1])]) for i in range(len(indptr) - 1)]
    if columns and any(e[0] >= columns for _, es in rows for e in es):
        raise ValueError("a column index is out of range")
    return spark.createDataFrame(rows, f"row_id long, entries {ENTRY}")


def from_csc(spark: SparkSession, indptr, indices, values) -> DataFrame:
    """row_id and entries of compressed columns; rows without entries aren't there."""
    cells = [(int(indices[k]), j, float(values[k])) for j in range(len(indptr) - 1) for k in range(indptr[j], indptr[j + 1])]
    return gather(spark.createDataFrame(cells, "row_id long, feature int, fvalue float"))


def gather(cells: DataFrame) -> DataFrame:
    """Rows (row_id, entries) of cells (row_id, feature, fvalue); a row has a bounded number of features."""
    return cells.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").alias("index"), "fvalue"))).alias("entries"))


def scatter(rows: DataFrame) -> DataFrame:
    """Cells (row_id, feature, fvalue) of rows with entries."""
    return rows.select("row_id", F.explode("entries").alias("e")).select("row_id", F.col("e.index").alias("feature"), F.col("e.fvalue").alias("fvalue"))


def widen(rows: DataFrame, columns: int, keep: list[str] = ()) -> DataFrame:
    """Rows with x, an array of ``columns`` floats, null where there is no entry."""
    def cell(j: int) -> Column:
        return F.get(F.transform(F.filter("entries", lambda e: e["index"] == j), lambda e: e["fvalue"]), F.lit(0))

    if columns <= 64:
        return rows.select(*keep, F.array(*[cell(j) for j in range(columns)]).alias("x"))
    at = F.map_from_entries("entries")
    return rows.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.try_element_at(at, j)).alias("x"))


def entries(df: DataFrame, features: list[str], keep: list[str] = ("row_id",)) -> DataFrame:
    """Rows with entries of the valid features, in order of index."""
    cells = F.array(*[F.struct(F.lit(i).alias("index"), valid(F.col(f"`{c}`")).alias("fvalue")) for i, c in enumerate(features)])
    return df.select(*keep, F.filter(cells, lambda e: e["fvalue"].isNotNull()).alias("entries"))


def reindex(rows: DataFrame, offset: int) -> DataFrame:
    """Entries with all column indices moved by ``offset``."""
    return rows.withColumn("entries", F.transform("entries", lambda e: F.struct((e["index"] + offset).alias("index"), e["fvalue"].alias("fvalue"))))


def save(df: DataFrame, path: str, names: list[str] | None = None, types: list[str] | None = None) -> None:
    """Store a frame as Parquet with a schema note of feature names and types beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    note = json.dumps({"version": [3, 5, 0], "feature_names": names or [], "feature_types": types or []})
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The frame and the schema note of a stored matrix."""
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/schema").first()[0])
