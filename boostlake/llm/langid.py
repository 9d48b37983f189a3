"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language on the executors; the log-probability matrix
(languages x buckets, a fixed size) is broadcast and batches are scored in numpy: n-grams of a few documents
become a sparse matrix of counts (documents x buckets), which is multiplied with the log-probabilities
of all languages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded, mix64

#: Language given to texts without a letter.
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Documents whose counts are held at a time.
ROWS = 32


@dataclass(frozen=True)
class LanguageModel:
    """languages: names; logp: float32 (languages, buckets); prior: log class shares; orders: n-gram lengths."""

    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of the n-gram at each character, and whether it lies in one text. Texts stand between spaces."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in padded])
    room = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(len(points))
    for n in orders:
        code = np.full(len(points), n, np.uint64)
        for k in range(n):
            code[: len(points) - k] = code[: len(points) - k] * np.uint64(0x100000001B3) + points[k:]
        yield (mix64(code) % np.uint64(buckets)).astype(np.int64), room >= n


def train(docs: DataFrame, *, orders: tuple[int, ...] = (2, 3), buckets: int = 1 << 15, max_docs: int = 20_000, smoothing: float = 0.1, max_languages: int = 500) -> LanguageModel:
    """Fit on ``docs`` (doc_id, text, lang) with non-null text and lang.

    ``max_docs`` bounds the sample of labelled rows: those with the smallest hash of doc_id, so it is
    the same whatever the partitioning. Without a labelled row the model has no languages and
    everything is predicted ``und``. More than ``max_languages`` languages are an error, as they would make a model too
    large to broadcast.
    """
    bounded(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in blocks(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                n[lang] = n.get(lang, 0) + len(own)
                sums = total.setdefault(lang, np.zeros(buckets, np.int64))
                for ids, inside in _grams(own, orders, buckets):
                    sums += np.bincount(ids[inside], minlength=buckets)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": [-1, *at.tolist()], "n": [n[lang], *sums[at].tolist()]})

    picked = labelled.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    found = picked.select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if their matrix can be broadcast")
    rows = picked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(names), buckets))
    prior = np.zeros(len(names))
    for r in rows:
        if r["bucket"] < 0:
            prior[names.index(r["lang"])] = r["n"]
        else:
            counts[names.index(r["lang"]), r["bucket"]] = r["n"]
    smoothed = counts + smoothing
    logp = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32) if names else counts.astype(np.float32)
    return LanguageModel(names, logp, np.log(prior / max(prior.sum(), 1)) if names else prior, tuple(orders))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; of languages that tie the first by name."""
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not at or not model.languages:
        return names, best
    logs = np.tile(model.prior, (len(at), 1))
    buckets, table = model.logp.shape[1], np.ascontiguousarray(model.logp.T)
    for first in range(0, len(at), ROWS):
        own = [texts[i] for i in at[first : first + ROWS]]
        sizes = [len(t.lower()) + 2 for t in own]
        row = np.repeat(np.arange(len(own)) * buckets, sizes)
        counts = np.zeros(len(own) * buckets, np.int64)
        for ids, inside in _grams(own, model.orders, buckets):
            counts += np.bincount((row + ids)[inside], minlength=len(counts))
        # the sparse matrix: cells that aren't 0, by document
        cell = np.flatnonzero(counts)
        weighted = table[cell % buckets] * counts[cell, None]
        begin = np.searchsorted(cell, np.arange(len(own)) * buckets)
        logs[first : first + len(own)] += np.add.reduceat(weighted, begin, axis=0, dtype=np.float64)
    top = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    for i, k, p in zip(at, top, share, strict=True):
        names[i], best[i] = model.languages[k], p
    return names, best


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; ``keep`` names the columns to carry (all by default, less clashing names).

    Null and letterless texts give ``und`` with score 0. Every row is scored on its own whole text.
    """
    spark = docs.sparkSession
    bounded(spark)
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            lang, p = score_texts(batch.column("__text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), pa.array(lang), pa.array(p)], names=[*carried, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).alias("__text"))
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text falls in ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
