"""Quality rules in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows of each text. The verdict is a
length-normalised log-likelihood ratio: words and word pairs are hashed into buckets, smoothed multinomials of
trusted target texts and of the whole corpus give each bucket a log ratio, and a text is kept if the mean over its
n-grams reaches a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import durable

SPACE = r"[\\x20\\x09-\\x0D]+"


def words_of(text: str = "text") -> Column:
    """Words: runs of characters other than ASCII white space; null text has none."""
    return F.expr(f"array_remove(split(coalesce({text}, ''), '{SPACE}'), '')")


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with words, h (64-bit hash of each word) and p (hash of each pair of neighbouring words), each computed once."""
    pairs = F.expr("zip_with(slice(h, 1, greatest(size(h) - 1, 0)), slice(h, 2, size(h)), (a, b) -> xxhash64(a, b))")
    return docs.withColumn("words", words_of(text)).withColumn("h", F.expr("transform(words, w -> xxhash64(w))")).withColumn("p", pairs)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with words, h and p, and the long columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are compared by 64-bit hashes within one text.
    """
    windows = "if(size(h) < 6, cast(array() as array<bigint>), transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))"
    placed = "array_sort(transform(g, (x, i) -> struct(x, i)))"
    again = "array_sort(filter(transform(s, (e, j) -> if(e.x <=> get(s, j - 1).x or e.x <=> get(s, j + 1).x, e.i, null)), i -> i is not null))"
    covered = f"aggregate({again}, named_struct('n', 0L, 'upto', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(i, a.upto), 'upto', i + 5), a -> a.n)"
    repeats = f"if(size(array_distinct(g)) = size(g), 0L, element_at(transform(array({placed}), s -> {covered}), 1))"
    lines = rf"filter(split(coalesce({text}, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    return (
        hashed(docs, text)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.expr(f"cast(regexp_count(coalesce({text}, ''), '[#*$%&|<>]') as long)"))
        .withColumn("n_dup_lines", F.expr(f"element_at(transform(array({lines}), x -> cast(size(x) - size(array_distinct(x)) as long)), 1)"))
        .withColumn("g", F.expr(windows))
        .withColumn("n_repeat_words", F.expr(repeats))
        .drop("g")
    )


def failed() -> Column:
    """The base rules' verdict: under 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def trusted_ids(labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Ids of trusted target texts: labelled quality 1, at most ``max_rows``, those with the smallest hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def log_ratios(docs: DataFrame, trusted: DataFrame, *, buckets: int = 1 << 16, smoothing: float = 1.0) -> DataFrame:
    """(bucket, llr) over the buckets that occur: log of target share over corpus share. Counts cover all of ``docs``.

    ``trusted`` (doc_id) is a bounded list. Without trusted texts every ratio is 0.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("own", F.lit(1))), "doc_id", "left")
    counted = hashed(marked).select("own", F.explode(F.concat("h", "p")).alias("gram")).groupBy(F.expr(f"cast(pmod(gram, {buckets}L) as int)").alias("bucket")).agg(F.count("*").alias("raw"), F.count("own").alias("target"))
    counts = durable(counted, "ngrams")  # read twice, by the totals and by the ratios
    totals = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    both = counts.join(F.broadcast(totals))  # one row of totals
    ratio = F.log((F.col("target") + smoothing) / (F.col("targets") + smoothing * buckets)) - F.log((F.col("raw") + smoothing) / (F.col("raws") + smoothing * buckets))
    return both.select("bucket", F.when(F.col("targets") > 0, ratio).otherwise(0.0).alias("llr"))


def dense(ratios: DataFrame, buckets: int) -> DataFrame:
    """One row: the array of the ratios of all ``buckets`` buckets, 0 where a bucket has none."""
    every = ratios.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(F.broadcast(ratios), "bucket", "left").select("bucket", F.coalesce("llr", F.lit(0.0)).alias("llr"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "llr"))).alias("all")).select(F.col("all.llr").alias("llr"))


def judge(docs: DataFrame, ratios: DataFrame, *, buckets: int = 1 << 16, threshold: float = -0.2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts, base_failed, llr (mean over n-grams) and kept.

    Null and empty texts have no words, fail the base rules and have llr 0. Repeated rows are judged one by one, texts of
    any length whole; a tie with the threshold is kept. Other columns of ``docs`` aren't read. ``ratios`` has at most
    ``buckets`` rows; they reach the rows of ``docs`` as one array.
    """
    counted = base_counts(docs.select(F.col("doc_id").cast("long"), "text"))
    table = durable(dense(ratios, buckets), "ratios").scalar()
    add = f"(a, x) -> a + ratios[cast(pmod(x, {buckets}L) as int)]"
    total, n = F.expr(f"aggregate(p, aggregate(h, 0D, {add}), {add})"), F.size("h") + F.size("p")
    scored = counted.withColumn("ratios", table).withColumn("llr", F.when(n == 0, F.lit(0.0)).otherwise(total / n))
    return scored.withColumn("base_failed", failed()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
