"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each word to a symbol (insult, threat, target, negation, report or other) and a magnitude:
insults are word prefixes learned from labelled rows, with learned weights, and a small fixed list. Four more transducers
read symbols and write symbols: negation weakens insults and erases threats of the words that follow, reported speech
weakens the rest of the clause, a threat needs a target close behind, and a target makes insults weigh more. They are
composed into one table of states and arcs. An arc weighs magnitude * factor + bonus; in a cascade factors multiply and
bonuses are scaled by the factors of the transducers that follow. A clause scores the sum along its path and the weight
of the state where it ends. A document's score is the logistic of all matched clauses less the weight expected by
chance.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded, drop, durable

# Seed words of the grammar.
INSULTS = "idiot stupid moron imbecile scum loser pathetic worthless disgusting trash clown bastard asshole bitch dumbass vermin filth subhuman retard scumbag degenerate".split()
THREATS = "kill murder hurt beat destroy shoot stab burn hang strangle".split()
TARGETS = frozenset("you your yours youre u ur they them he him she her those these du dich dir ihr euch tu te toi vous ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never neither nor without hardly kein keine nicht nie ne pas jamais non nunca ni isnt arent wasnt werent dont doesnt didnt wont cant couldnt wouldnt shouldnt aint".split())
REPORTS = frozenset("said says say told wrote writes quoted reported claimed called according sagte schrieb dit disait dijo dice escribio".split())

#: Words are runs of letters; a short form of "not" (n't) stays with its word, other apostrophes part words.
_WORD = re.compile(r"[^\W\d_]+n['\u2019]t\b|[^\W\d_]+")
_CLAUSE = re.compile(r"[^.!?;\n]+")
#: Most a single mark weighs, and what a document's weights must exceed.
CAP, BIAS = 4.0, 3.0
PREFIXES = range(3, 9)

# Symbols that transducers read and write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)


@dataclass(frozen=True)
class Arc:
    """What a state does on a symbol: the next state, the symbol written, and the weight magnitude * factor + bonus."""

    to: int
    out: int
    factor: float = 1.0
    bonus: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: ``arcs[state][symbol]``, starting in state 0; ``final`` scales a path's weight
    by the state where it ends."""

    arcs: tuple[tuple[Arc, ...], ...]
    final: tuple[float, ...]


def transducer(states: int, arcs: dict[tuple[int, int], Arc], onward: tuple[int, ...], final: tuple[float, ...] | None = None) -> Transducer:
    """Arcs by (state, symbol); where none is given the symbol is copied and the state goes to ``onward[state]``."""
    return Transducer(tuple(tuple(arcs.get((s, x), Arc(onward[s], x)) for x in SYMBOLS) for s in range(states)), final or (1.0,) * states)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The cascade: ``second`` reads what ``first`` writes. Only pairs of states that can be reached are kept."""
    number, arcs, final, todo = {(0, 0): 0}, [], [], [(0, 0)]
    while todo:
        a, b = todo.pop(0)
        row = []
        for x in SYMBOLS:
            u = first.arcs[a][x]
            v = second.arcs[b][u.out]
            pair = (u.to, v.to)
            if pair not in number:
                number[pair] = len(number)
                todo.append(pair)
            row.append(Arc(number[pair], v.out, u.factor * v.factor, u.bonus * v.factor + v.bonus))
        arcs.append(tuple(row))
        final.append(first.final[a] * second.final[b])
    return Transducer(tuple(arcs), tuple(final))


@functools.lru_cache
def cascade() -> tuple[Transducer, ...]:
    """Negation, threat, reported speech and target, in the order in which they read."""
    scope = 4  # words that a negation or a threat reaches
    down = (0, *range(scope))
    negation = {(s, NEGATION): Arc(scope - 1, NEGATION) for s in range(scope)}
    negation |= {(s, INSULT): Arc(s - 1, INSULT, 0.6) for s in range(1, scope)} | {(s, THREAT): Arc(s - 1, OTHER) for s in range(1, scope)}
    # the state counts how many words a threat still waits for its target; a target that it meets bears its weight
    threat = {(s, THREAT): Arc(scope, OTHER, 0.0) for s in range(scope + 1)} | {(s, TARGET): Arc(0, TARGET, 0.0, 3.0) for s in range(1, scope + 1)}
    report = {(0, REPORT): Arc(1, REPORT)} | {(1, x): Arc(1, x, 0.8) for x in SYMBOLS}
    target = {(s, TARGET): Arc(1, TARGET) for s in (0, 1)}
    return (
        transducer(scope, negation, down[:scope]),
        transducer(scope + 1, threat, down),
        transducer(2, report, (0, 1)),
        transducer(2, target, (0, 1), (1.0, 1.1)),
    )


@functools.lru_cache
def composed() -> Transducer:
    return functools.reduce(compose, cascade())


@dataclass(frozen=True)
class Grammar:
    """insults: prefix to weight; background: weight expected per word of clean text."""

    insults: dict[str, float]
    background: float


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(text: str) -> Counter:
    """Occurrences of word prefixes (whole words where shorter), and of all words under the empty name."""
    words = Counter(_WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) >= k:
                out[w[:k]] += n
    out[""] = sum(words.values())
    return out


def _near_key(text: str) -> int:
    """Least hash of the text's three-word shingles: most near copies of a text agree on it."""
    words = text.split()
    return min((_hash(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def learn(docs: DataFrame, labels: DataFrame, *, max_rows: int = 10_000, min_evidence: float = 25.0, max_prefixes: int = 2000) -> Grammar:
    """Learn insult prefixes from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``max_rows`` bounds the labelled rows of each class, those with the smallest hash of doc_id. One text of each
    group of near copies counts. A prefix is kept if the likelihood-ratio statistic of its document counts reaches
    ``min_evidence``, the strongest first; ``max_prefixes`` bounds the list. Without labels the fixed list is all.
    """
    spark = docs.sparkSession
    bounded(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_rows))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_near_key(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(batch.column(c) for c in ("doc_id", "toxic", "text"))], names=["key", "doc_id", "toxic", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f, n in _features(text).items():
                    at = total.setdefault(f, [0, 0, 0, 0])
                    at[toxic * 2] += n
                    at[toxic * 2 + 1] += 1
            if len(total) > 200_000:
                yield _counts(total)
                total = {}
        if total:
            yield _counts(total)

    one_each = durable(rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(keyed, "key long, doc_id long, toxic int, text string").groupBy("key").agg(F.min_by(F.struct("toxic", "text"), "doc_id").alias("r")).select("r.*"), "labelled")  # read three times
    sums = one_each.mapInArrow(count, "feature string, clean_n long, clean_docs long, toxic_n long, toxic_docs long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean_n", "clean_docs", "toxic_n", "toxic_docs")])
    whole = one_each.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("c")).first()
    seeds = {w: CAP for w in INSULTS}
    if not whole["t"] or not whole["c"]:
        drop(one_each)
        return Grammar(seeds, 0.0)
    t, c = F.col("toxic_docs"), F.col("clean_docs")
    share = whole["t"] / (whole["t"] + whole["c"])
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((t + c) * p))).otherwise(0.0)
    evidence = 2 * (part(t, share) + part(c, 1 - share))
    found = sums.where("feature <> '' and toxic_docs >= 3").withColumn("evidence", evidence).where((F.col("evidence") >= min_evidence) & (t / whole["t"] > c / whole["c"]))
    best = found.orderBy(F.desc("evidence"), F.desc(F.length("feature")), "feature").limit(max_prefixes).collect()
    words = sums.where("feature = ''").first()
    drop(one_each)
    insults: dict[str, float] = {}
    background = 0.0
    for r in best:
        f = r["feature"]
        if any(f.startswith(x) or x.startswith(f) for x in insults):
            continue
        toxic_rate, clean_rate = (r["toxic_n"] + 0.5) / words["toxic_n"], (r["clean_n"] + 0.5) / words["clean_n"]
        weight = min(CAP, math.log(toxic_rate / clean_rate))
        if weight > 1:
            insults[f] = weight
            background += weight * r["clean_n"] / words["clean_n"]
    for w, weight in seeds.items():
        if not any(w.startswith(x) for x in insults):
            insults[w] = weight
    return Grammar(insults, background)


def _counts(total: dict[str, list[int]]) -> pa.RecordBatch:
    columns = list(zip(*total.values(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array(x, pa.int64()) for x in columns)], names=["feature", "clean_n", "clean_docs", "toxic_n", "toxic_docs"])


class Scorer:
    """The grammar compiled for a worker."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.marks = ahocorasick.Automaton()
        for p in [*grammar.insults, *THREATS]:
            self.marks.add_word(p, len(p))
        self.marks.make_automaton()
        self.lengths = sorted({len(p) for p in grammar.insults}, reverse=True)
        self.table = composed()

    def _weight(self, word: str) -> float:
        for k in self.lengths:
            if (w := self.grammar.insults.get(word[:k])) is not None and len(word) >= k:
                return w
        return 0.0

    def read(self, text: str) -> list[tuple[int, float]]:
        """The lexical transducer: symbol and magnitude of each word of a lower-cased clause."""
        out = []
        for word in _WORD.findall(text):
            plain = word.replace("'", "").replace("\u2019", "")
            if plain in NEGATIONS or plain != word:
                out.append((NEGATION, 0.0))
            elif plain in REPORTS:
                out.append((REPORT, 0.0))
            elif plain in TARGETS:
                out.append((TARGET, 0.0))
            elif plain in THREATS:
                out.append((THREAT, 0.0))
            else:
                w = self._weight(plain)
                out.append((INSULT, w) if w > 0 else (OTHER, 0.0))
        return out

    def clause(self, text: str) -> float:
        """Weight of one lower-cased clause: of its one path through the composed table."""
        arcs, state, total = self.table.arcs, 0, 0.0
        for symbol, magnitude in self.read(text):
            arc = arcs[state][symbol]
            total += magnitude * arc.factor + arc.bonus
            state = arc.to
        return total * self.table.final[state]

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed clause weights less what chance gives, and the number of clauses that matched."""
        if not text:
            return 0.0, 0
        low = text.lower()
        ends = [e for e, n in self.marks.iter(low) if e < n or not low[e - n].isalpha()]
        if not ends:
            return 0.0, 0
        total, matched, i = 0.0, 0, 0
        for m in _CLAUSE.finditer(low):
            while i < len(ends) and ends[i] < m.start():
                i += 1
            if i < len(ends) and ends[i] < m.end() and (w := self.clause(m[0])) > 0:
                total += w
                matched += 1
        return total - self.grammar.background * (low.count(" ") + 1), matched

    def score(self, text: str | None) -> tuple[float, int]:
        """Score from 0 to 1 and the number of matched clauses."""
        e, matched = self.evidence(text)
        return 1 / (1 + math.exp(max(-60.0, min(60.0, BIAS - e)))), matched


def score(docs: DataFrame, grammar: Grammar, *, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score, predicted (1 from ``threshold`` up, so a tie counts) and n_clauses. Null and empty texts score
    as clean, texts of any length by all their clauses, repeated rows alike; columns with the three names are replaced."""
    spark = docs.sparkSession
    bounded(spark)
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted", "n_clauses")]
    shared = spark.sparkContext.broadcast(grammar)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in blocks(batches, "__text"):
            scores, matched = zip(*(own.score(t) for t in batch.column("__text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carried))), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(matched, pa.int64())],
                names=[*carried, "score", "predicted", "n_clauses"],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{fields}score double, predicted int, n_clauses long")
