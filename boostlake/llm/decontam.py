"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``guard`` consecutive k-gram hashes of a text the least is its fingerprint, so that a shared span of
k + guard - 1 words always shares one. Fingerprints of documents are joined with those of the benchmark; a common one is
then extended at its place: the word windows around it, in which it is the least hash, are joined as strings with the
benchmark's windows, and the words of matching windows are hits. Items too short to be winnowed give all their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import drop, durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of the benchmark's side of a join up to which it is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def words_of(text: str = "text") -> Column:
    """Words of the text with A-Z lower-cased: runs of a-z, 0-9 and characters beyond ASCII. Null has none."""
    return F.expr(f"array_remove(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), '')")


def _gram(n: int) -> str:
    return "transform(sequence(0, size(h) - {n}), i -> xxhash64({args}))".format(n=n, args=", ".join([str(n), *(f"h[i + {j}]" if j else "h[i]" for j in range(n))]))


def _of_words(k: int, guard: int, short: list[int], winnowed: str, whole: str, empty: str) -> Column:
    """Concatenation of ``winnowed`` of the k-gram hashes g, and of ``whole`` of all n-gram hashes g for each n of ``short``."""
    one = lambda n, least, made: f"if(size(h) < {least}, {empty}, element_at(transform(array({_gram(n)}), g -> {made}), 1))"
    parts = [one(k, k + guard - 1, winnowed), *(one(n, n, whole.replace("{n}", str(n))) for n in short)]
    return F.expr(f"element_at(transform(array(transform(words, w -> xxhash64(w))), h -> concat({', '.join(parts)})), 1)")


def _least(guard: int) -> str:
    return f"transform(sequence(0, size(g) - {guard}), i -> least({', '.join(f'g[i + {j}]' for j in range(guard))}))"


def fingerprints(k: int, guard: int, short: list[int] = ()) -> Column:
    """Distinct winnowed k-gram hashes of the column words; with all its n-gram hashes for each n of ``short``."""
    return _of_words(k, guard, short, f"array_distinct({_least(guard)})", "array_distinct(g)", "cast(array() as array<bigint>)")


def placed_fingerprints(k: int, guard: int, short: list[int] = ()) -> Column:
    """Windows of the column words with their fingerprint: at (first word), n (words) and mark, the least k-gram hash of
    a window of k + guard - 1 words, or the hash of all n words for each n of ``short``."""
    winnowed = f"transform({_least(guard)}, (x, i) -> named_struct('at', i, 'n', {k + guard - 1}, 'mark', x))"
    return _of_words(k, guard, short, winnowed, "transform(g, (x, i) -> named_struct('at', i, 'n', {n}, 'mark', x))", "cast(array() as array<struct<at:int,n:int,mark:bigint>>)")


def _small(df: DataFrame) -> DataFrame:
    """A table, marked for broadcast if its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(n: int) -> Column:
    """Windows of n consecutive words of the column words, as strings, with their place."""
    return F.expr(f"if(size(words) < {n}, cast(array() as array<struct<at:int,n:int,win:string>>), transform(sequence(0, size(words) - {n}), i -> named_struct('at', i, 'n', {n}, 'win', array_join(slice(words, i + 1, {n}), ' '))))")


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 6, text_keys: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted item ids as strings).

    ``benchmark`` has item_id and text. A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. A document's word inside any occurrence of a window is a hit.
    Items whose item_id is null make hits like others but aren't in items. Null and empty texts on either side have no
    words. Results follow from the text, so equal texts get equal results; repeated rows and ids stay. Other columns of
    either table aren't read. ``text_keys`` adds k1 and k2, hashes of the text.
    """
    guard = window - k + 1
    bench = durable(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).where("size(words) > 0"), "benchmark")
    short = sorted(r[0] for r in bench.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # under `window` numbers
    wins = bench.select("item_id", F.explode(F.when(F.size("words") >= window, windows(window)).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.size("words").alias("n"), F.array_join("words", " ").alias("win"))))).alias("w")).select("item_id", "w.n", "w.win").distinct()
    marks = bench.select(F.explode(fingerprints(k, guard, short)).alias("mark")).distinct().withColumn("hit", F.lit(1))
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    rows = docs.select(F.col("doc_id").cast("long"), *key, words_of().alias("words")).withColumn("n_words", F.size("words").cast("long")).withColumn("row", F.monotonically_increasing_id())
    id_columns = ["row", "doc_id", "k1", "k2", "n_words"]
    marked = rows.select(*id_columns, F.explode_outer(fingerprints(k, guard, short)).alias("mark")).join(_small(marks), "mark", "left")
    base = durable(marked.groupBy(*id_columns).agg(F.max("hit").alias("hit")).drop("row"), "marked")
    # one document stands for all copies of its text, so that copies don't meet in a task
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    suspects = durable(base.where("hit = 1").groupBy("k1", "k2").agg(F.min(place).alias("place")), "suspects")
    texts = docs.where("text is not null").select(place.alias("place"), *key, "text").join(_small(suspects), ["place", "k1", "k2"], "left_semi")
    texts = durable(texts.dropDuplicates(["k1", "k2"]).select("k1", "k2", words_of().alias("words")), "suspects")
    # places only: words of a long text aren't copied to each of its windows
    met = texts.select("k1", "k2", F.explode(placed_fingerprints(k, guard, short)).alias("p")).select("k1", "k2", "p.*").join(_small(marks.select("mark")), "mark")
    spots = met.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("spots"))
    extended = texts.join(spots, ["k1", "k2"]).select("k1", "k2", F.explode(F.expr("transform(spots, s -> named_struct('at', s.at, 'n', s.n, 'win', array_join(slice(words, s.at + 1, s.n), ' ')))")).alias("w"))
    placed = extended.select("k1", "k2", "w.*")
    found = placed.join(_small(wins), ["n", "win"])
    covered = "aggregate(array_sort(spans), named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.at + s.n - greatest(s.at, a.upto)), 'upto', greatest(a.upto, s.at + s.n)), a -> a.n)"
    hits = durable(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items")).select("k1", "k2", F.expr(covered).alias("n_hit"), "items"), "hits")
    drop(suspects), drop(texts)
    none = F.array().cast("array<string>")
    return base.join(_small(hits), ["k1", "k2"], "left").select("doc_id", *(["k1", "k2"] if text_keys else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``scan`` finds hits in; the rest is unchanged."""
    found = scan(docs.select("doc_id", "text"), benchmark, text_keys=True, **options).where("n_hit > 0")
    gone = durable(found.select("k1", "k2").distinct(), "contaminated")
    keyed = docs.withColumns({"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")})
    return keyed.join(_small(gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))), ["__k1", "__k2"], "left_anti").select(*docs.columns)


def digest(scanned: DataFrame) -> DataFrame:
    """The results of ``scan`` with the items as a count and a hash."""
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
