"""Row and metadata operators: slices, transposes, groups, categories, encodings, concatenation and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlake.session import FAN_IN

#: Groups of a stretch that one task sums up, about, if there are few enough stretches; one of so many groups is a candidate for a splitter.
STRETCH, DRAWN = 1 << 16, 1 << 10


def take_rows(df: DataFrame, wanted: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of ``df`` by a frame (pos, row_id): duplicates and their order are kept in pos. Spark picks the join."""
    return wanted.join(df, row_id)


def transpose(df: DataFrame, features: list[str], row_id: str = "row_id") -> DataFrame:
    """Cells (feature, row_id, fvalue) of the valid values, by column."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").cast("float").alias("fvalue")) for i, c in enumerate(features)])
    return df.select(row_id, F.explode(cells).alias("e")).select(F.col("e.feature").alias("feature"), row_id, F.col("e.fvalue").alias("fvalue")).where(F.col("fvalue").isNotNull() & ~F.isnan("fvalue"))


def group_pointers(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """Start and end of each group from group sizes; one row per group.

    Groups lie in at most FAN_IN stretches between splitters, which are drawn by hash; a task sums up one stretch, from the sum of those
    before it.
    """
    one = F.col(f"`{group}`")
    told = sorted(r[0] for r in sizes.where(F.pmod(F.xxhash64(one), F.lit(DRAWN)) == 0).where(one.isNotNull()).select(one).collect() if r[0] == r[0])
    step = max(STRETCH // DRAWN, -(-len(told) // FAN_IN))
    at = _stretch_of(one, told[step::step])
    sums = {r["at"]: r["n"] for r in sizes.groupBy(at.alias("at")).agg(F.sum(size).alias("n")).collect()}  # FAN_IN at most
    before, total = [], 0
    for i in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(i) or 0
    upto = F.sum(size).over(Window.partitionBy(at).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)) + F.element_at(F.array(*map(F.lit, before)), at + 1)
    return sizes.select(group, (upto - F.col(size)).alias("start"), upto.alias("end"))


def _stretch_of(x: Column, splitters: list, first: int = 0) -> Column:
    """Number of the splitters that aren't above x; 0 where it is missing."""
    if not splitters:
        return F.lit(first)
    k = len(splitters) // 2
    return F.when(x >= F.lit(splitters[k]), _stretch_of(x, splitters[k + 1 :], first + k + 1)).otherwise(_stretch_of(x, splitters[:k], first))


def query_runs(df: DataFrame, qid: str, row_id: str, ordered: bool = False) -> DataFrame:
    """Queries in row order: qid, first row and number of rows. With ``ordered`` a query whose rows lie among those of
    others is an error: each must end before the next one begins. Without it rows count wherever they lie."""
    if not ordered:
        return df.groupBy(qid).agg(F.min(row_id).alias("first"), F.count("*").alias("n"))
    runs = df.groupBy(qid).agg(F.min(row_id).alias("first"), F.max(row_id).alias("last"), F.count("*").alias("n"))
    after = F.lead("first").over(Window.orderBy("first"))  # one row per query
    wrong = F.coalesce(F.col("last") >= after, F.lit(False))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("query comes back: "), F.col(qid).cast("string"))).cast("long")).otherwise(F.col("n"))
    return runs.select(qid, "first", checked.alias("n"))


def unroll_weights(df: DataFrame, weights: DataFrame, qid: str) -> DataFrame:
    """Group weights on every row of their group."""
    return df.join(weights, qid, "left")


def density(df: DataFrame, features: list[str]) -> DataFrame:
    """Valid values and density of each feature."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")), 1)).alias(f"c{i}") for i, c in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("valid"), (F.col(f"c{i}") / F.col("n")).alias("density")) for i, c in enumerate(features)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def rank_within(df: DataFrame, qid: str, score: str, row_id: str) -> DataFrame:
    """``df`` with place, from 1 for the best score of a query; ties follow row_id."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(score), row_id)))


def recode(new: DataFrame, feature: str, categories: DataFrame) -> DataFrame:
    """Codes of category names from a dictionary (value, code); a name it lacks is an error."""
    joined = new.join(categories.select(F.col("value").alias(feature), F.col("code")), feature, "left")
    return joined.withColumn("code", F.when(F.col("code").isNull() & F.col(feature).isNotNull(), F.raise_error(F.concat(F.lit("unknown category "), F.col(feature))).cast("int")).otherwise(F.col("code")))


def dictionary(df: DataFrame, feature: str) -> DataFrame:
    """(value, code): categories in order of name."""
    return df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("value")).distinct().withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def one_hot(df: DataFrame, feature: str, values: list, prefix: str) -> DataFrame:
    """``df`` with a 0/1 column per value."""
    return df.withColumns({f"{prefix}{v}": (F.col(feature) == v).cast("int") for v in values})


def concat(frames: list[DataFrame], qid: str | None = None) -> DataFrame:
    """Rows of all frames; query ids of later ones are moved past those before."""
    out, offset = frames[0], 0
    for before, df in zip(frames[:-1], frames[1:], strict=True):
        if qid:
            top = before.agg(F.max(qid)).first()[0]
            offset += 0 if top is None else top + 1
            df = df.withColumn(qid, F.col(qid) + offset)
        out = out.unionByName(df)
    return out


def hash_split(df: DataFrame, row_id: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by the hash of row_id, the first with about ``share`` of the rows."""
    low = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(low), df.where(~low)


def nist_quantile(df: DataFrame, value: str, alpha: float) -> DataFrame:
    """Quantile with interpolation at alpha * (n + 1); counts of distinct values are cumulated."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    x = F.lit(alpha) * (F.col("n") + 1)
    k = F.greatest(F.lit(1), F.least(F.floor(x), F.col("n") - 1))
    picked = run.agg(at(k).alias("a"), at(k + 1).alias("b"), F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    x2 = F.lit(alpha) * (F.col("n") + 1)
    value_ = F.col("a") + (x2 - F.floor(x2)) * (F.col("b") - F.col("a"))
    return picked.select(F.when(F.lit(alpha) <= 1 / (F.col("n") + 1), F.col("low")).when(F.lit(alpha) >= F.col("n") / (F.col("n") + 1), F.col("high")).otherwise(value_).alias("value"))


def weighted_mean(df: DataFrame, y: Column, w: Column) -> DataFrame:
    return df.agg((F.sum(y * w) / F.sum(w)).alias("value"))


def class_histogram(df: DataFrame, label: str, weight: Column) -> DataFrame:
    return df.groupBy(label).agg(F.sum(weight).alias("w"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def r_squared(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Coefficient of determination in one pass."""
    return df.select(y.alias("y"), p.alias("p")).agg((1.0 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (F.var_pop("y") * F.count("y"))).alias("value"))
