"""Frames of the driver tables that the registered queries share, and the same frames in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlake.plans.registry import read


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: margins s, s1, s2, labels, weight, query and censoring bounds, all from its keys."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    num = lambda c: c.cast("double")
    return o.select(
        k.alias("row_id"), F.col("o_custkey").alias("qid"),
        ((num((k * 37) % 101) - 50) / 25).alias("s"), ((num((k * 53) % 89) - 44) / 30).alias("s1"), ((num((k * 29) % 97) - 48) / 40).alias("s2"),
        num((k % 3 == 0).cast("int")).alias("yb"), (num(k % 50) / 10).alias("yr"), num(k % 3).alias("yc"), num(F.least(k % 5, F.lit(4))).alias("rel"),
        (num(k % 4) / 2 + 0.5).alias("w"), (num(k % 40) + 1).alias("lo"), F.when(k % 4 == 0, F.lit(float("inf"))).when(k % 4 == 1, num(k % 40) + 1).otherwise(num(k % 40) + 8).alias("hi"),
        F.when(k % 3 == 0, -(num(k % 60) + 1)).otherwise(num(k % 60) + 1).alias("tc"),
        F.col("o_totalprice").cast("float").alias("price"), F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), F.when(k % 10 == 0, None).otherwise(F.datediff("o_orderdate", F.lit("1992-01-01"))).cast("float").alias("days"), num((F.col("o_orderstatus") == "F").cast("int")).alias("is_f"),
    )


ORDERS = """b AS (SELECT o_orderkey AS row_id, o_custkey AS qid,
    (CAST((o_orderkey * 37) % 101 AS DOUBLE) - 50) / 25 AS s, (CAST((o_orderkey * 53) % 89 AS DOUBLE) - 44) / 30 AS s1, (CAST((o_orderkey * 29) % 97 AS DOUBLE) - 48) / 40 AS s2,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS yb, CAST(o_orderkey % 50 AS DOUBLE) / 10 AS yr, CAST(o_orderkey % 3 AS DOUBLE) AS yc, CAST(o_orderkey % 5 AS DOUBLE) AS rel,
    CAST(o_orderkey % 4 AS DOUBLE) / 2 + CAST(0.5 AS DOUBLE) AS w, CAST(o_orderkey % 40 AS DOUBLE) + 1 AS lo,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 40 AS DOUBLE) + 1 ELSE CAST(o_orderkey % 40 AS DOUBLE) + 8 END AS hi,
    CASE WHEN o_orderkey % 3 = 0 THEN -(CAST(o_orderkey % 60 AS DOUBLE) + 1) ELSE CAST(o_orderkey % 60 AS DOUBLE) + 1 END AS tc,
    CAST(o_totalprice AS FLOAT) AS price, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS FLOAT) END AS days, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS is_f
    FROM orders)"""
