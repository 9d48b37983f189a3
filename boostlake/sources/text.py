"""Text sources: LIBSVM and CSV lines to feature frames, and the location strings that name them."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Location:
    """A path, its format (libsvm or csv) and further options."""

    path: str
    format: str
    options: dict[str, str] = field(default_factory=dict)


def parse_location(text: str) -> Location:
    """Parse ``path?key=value&key=value``; the format must be given, ``auto`` is libsvm, a cache part isn't supported."""
    if text.count("#") > 1:
        raise ValueError("at most one # is allowed")
    if "#" in text:
        raise ValueError("caches on disk aren't supported; persist the frame")
    path, _, query = text.partition("?")
    options = dict(parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query)))
    kind = options.pop("format", None)
    if kind is None:
        raise ValueError("the location names no format")
    if kind not in ("auto", "libsvm", "csv"):
        raise ValueError(f"unknown format {kind}")
    return Location(path, "libsvm" if kind == "auto" else kind, options)


def read_text(spark: SparkSession, location: str) -> DataFrame:
    """Read a location: row_id, label, weight, qid (libsvm) and entries, or x (csv)."""
    at = parse_location(location)
    lines = spark.read.text(at.path).withColumn("row_id", F.monotonically_increasing_id())
    if at.format == "libsvm":
        return parse_libsvm(lines, int(at.options.get("indexing_mode", 0)))
    column = lambda k: int(at.options[k]) if k in at.options else None
    return parse_csv(lines, column("label_column"), column("weight_column"), at.options.get("delimiter", ","))


def parse_libsvm(lines: DataFrame, indexing_mode: int = 0) -> DataFrame:
    """``lines`` (value, row_id, ...) as label, weight, qid and entries, an array of (index, fvalue).

    A line is ``label[:weight] [qid:n] index[:value] ...`` up to a #; a value left out is 1. Mode 0 keeps indices,
    a positive mode takes one off, a negative one takes one off if no line uses index 0. Blank lines go.
    """
    bare = F.trim(F.element_at(F.split("value", "#", 2), 1))
    rows = lines.withColumn("t", F.split(bare, r"\s+")).where(F.element_at("t", 1) != "")
    head = F.split(F.element_at("t", 1), ":")
    rest = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    pairs = F.filter(rest, lambda x: ~x.startswith("qid:"))
    entry = lambda x: F.struct(F.element_at(F.split(x, ":"), 1).cast("int").alias("index"), F.coalesce(F.get(F.split(x, ":"), F.lit(1)).cast("float"), F.lit(1.0).cast("float")).alias("fvalue"))
    out = rows.withColumn("label", head[0].cast("float")).withColumn("weight", F.get(head, F.lit(1)).cast("float"))
    out = out.withColumn("qid", F.regexp_extract(F.get(F.filter(rest, lambda x: x.startswith("qid:")), F.lit(0)), r"qid:(\d+)", 1).cast("long"))
    out = out.withColumn("entries", F.transform(pairs, entry)).drop("t", "value")
    if indexing_mode < 0:
        least = out.select(F.array_min(F.transform("entries", lambda e: e["index"])).alias("m")).agg(F.min("m")).first()[0]
        indexing_mode = 1 if least is not None and least > 0 else 0
    if indexing_mode > 0:
        out = out.withColumn("entries", F.transform("entries", lambda e: F.struct((e["index"] - 1).alias("index"), e["fvalue"].alias("fvalue"))))
    return out


def parse_csv(lines: DataFrame, label_column: int | None = None, weight_column: int | None = None, delimiter: str = ",") -> DataFrame:
    """``lines`` (value, row_id, ...) without header as label, weight and x, an array of float.

    A cell that isn't a number is missing, in the label column 0; a byte order mark is skipped. A line without the
    delimiter is an error unless it is blank.
    """
    text = F.regexp_replace("value", "^﻿", "")
    quoted = "\\" + delimiter if delimiter in r"|.^$*+?()[]{}\\" else delimiter
    rows = lines.withColumn("c", F.split(text, quoted)).where(F.trim(text) != "")
    rows = rows.withColumn("c", F.when(F.size("c") < 2, F.raise_error(F.lit("a line lacks the delimiter"))).otherwise(F.col("c")))
    special = [k for k in (label_column, weight_column) if k is not None]
    cell = lambda k: F.trim(F.get("c", F.lit(k))).try_cast("float")
    label = F.coalesce(cell(label_column), F.lit(0.0).cast("float")) if label_column is not None else F.lit(None).cast("float")
    weight = cell(weight_column) if weight_column is not None else F.lit(None).cast("float")
    kept = F.filter("c", lambda v, i: ~i.isin(special)) if special else F.col("c")
    return rows.withColumn("label", label).withColumn("weight", weight).withColumn("x", F.transform(kept, lambda v: F.trim(v).try_cast("float"))).drop("c", "value")
