"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again each time it grows. Rolling hashes of turn prefixes identify logged
conversations that are a prefix of a longer one; anti-joins keep the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with n (place from 1) and the rolling hash (h1, h2) of the first n turns.

    Turns are ordered by turn, role and text, nulls first; the number itself isn't part of the hash. Rows without a
    conv_id belong to no conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.array(F.col("role").isNull(), F.col("text").isNull())
    return rows.withColumn("h1", F.bit_xor(F.xxhash64("n", known, "role", "text")).over(so_far)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit(1), "n", known, "text", "role")).over(so_far))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of another; of equal ones the smallest conv_id stays.
    ``turns`` has conv_id, turn, role and text. A conversation is held by its hashes alone, however long its turns are."""
    prefixes = prefix_hashes(turns)
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    first = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    size = whole.select("conv_id", F.col("n").alias("total"))
    inner = prefixes.select("conv_id", "n", "h1", "h2").join(size, "conv_id").where("n < total").select("n", "h1", "h2").distinct()
    return first.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, user: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_chars and rendered. ``user`` is the template of a turn; null role is
    ``unknown``, null text is empty. Of ``turns`` only conv_id, turn, role and text are read, so that others may have any
    name. A repeated row is one more turn: it is counted and rendered, and counts in prefixes too."""
    turns = turns.select("conv_id", "turn", "role", "text")
    before, _, rest = user.partition("{role}")
    middle, _, after = rest.partition("{text}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(after))
    kept = turns.join(maximal(turns), "conv_id")
    parts = kept.select("conv_id", "n_turns", F.struct(F.col("turn"), F.col("role"), F.col("text"), line.alias("line")).alias("t"))
    joined = parts.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "").alias("rendered"))
    return joined.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")
