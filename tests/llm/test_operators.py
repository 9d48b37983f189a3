"""The corpus operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from boostlake.llm import blocks, bpe, chat, dac, decontam, htmltext, jaccard, langid, quality, queries, suffixes, toxicity
from boostlake.llm.components import components

from . import brute

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string")


def corpus(seed, n=150):
    """Texts with shared passages, exact and near copies, runs of one character, nulls and empty ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéÀ日XY") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(25) for _ in range(3)]
    out = []
    for _ in range(n):
        kind, t = rng.random(), text(rng.randint(0, 80))
        if kind < 0.3:
            t = f"{text(rng.randint(0, 20))} {rng.choice(passages)} {text(rng.randint(0, 20))}"
        elif kind < 0.4 and out:
            t = rng.choice(out)
        elif kind < 0.6 and out and (old := rng.choice(out)):
            w = old.split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind < 0.65:
            t = rng.choice(["ab " * rng.randint(1, 120), "x" * rng.randint(90, 300), "\n\n \t", ""])
        elif kind < 0.68:
            t = None
        out.append(t)
    return out


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents benchmark conversations labels pages".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in "documents benchmark conversations labels pages".split():
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# 1: quality rules


def test_quality_counts_and_ratio(spark):
    texts = [*corpus(1, 60), "a b c d e a b c d e f g", "one two three four five six seven eight nine ten", "x\nx\n\nx | & #", None, "", "w " * 30_000]
    d = docs_of(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    buckets = 512
    got = {r.doc_id: r for r in quality.judge(d, quality.log_ratios(d, trusted, buckets=buckets), buckets=buckets).collect()}

    def grams(t):
        w = brute.space_words(t)
        single = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [h - 2**64 if h >= 2**63 else h for h in single]
        pairs = [xxhash.xxh64_intdigest(int(b & (2**64 - 1)).to_bytes(8, "little"), xxhash.xxh64_intdigest(int(a & (2**64 - 1)).to_bytes(8, "little"), 42)) for a, b in zip(signed, signed[1:])]
        return [h % buckets if h < 2**63 else (h - 2**64) % buckets for h in [*single, *pairs]]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 60 and i % 2 == 0:
            target.update(grams(t))
    ratio = {b: math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in raw}
    for i, t in enumerate(texts):
        w, g, r = brute.space_words(t), grams(t), got[i]
        again, lines = brute.repeats(t)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), lines, again)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * again > 20 * len(w))
        assert abs(r.llr - (sum(ratio[b] for b in g) / len(g) if g else 0)) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= -0.2)


# 2: toxicity


def test_toxicity_grammar():
    s = toxicity.Scorer(toxicity.Grammar({"idiot": 4.0, "lowei": 4.0}, 0.0))
    assert s.score("You are an idiot, a real idiot.")[0] > 0.9 and s.score("loweian und loweich")[0] > 0.7
    assert s.clause("he is not an idiot") < s.clause("he is an idiot")
    assert s.clause("he said idiot") < s.clause("idiot he cried")
    assert s.clause("i will kill you") > 0 and s.clause("i will kill time") == 0
    assert s.score("A fine day.")[0] < 0.1 and s.score("")[0] < 0.1 and s.score(None)[0] < 0.1 and s.score("nonidiotic") == s.score("x")


def test_toxicity_cascade_equals_paths():
    """The composed table against the four transducers one after another, over all short clauses of symbols."""
    for n in range(1, 5):
        for clause in itertools.product(toxicity.SYMBOLS, repeat=n):
            magnitudes = [1.0 + i if x == toxicity.INSULT else 0.0 for i, x in enumerate(clause)]
            # each word bears a weight that every transducer scales and adds to
            weights, symbols, scale = list(magnitudes), list(clause), 1.0
            for t in toxicity.cascade():
                state = 0
                for i, x in enumerate(symbols):
                    arc = t.arcs[state][x]
                    weights[i], symbols[i], state = weights[i] * arc.factor + arc.bonus, arc.out, arc.to
                scale *= t.final[state]
            table, state, total = toxicity.composed(), 0, 0.0
            for x, m in zip(clause, magnitudes, strict=True):
                arc = table.arcs[state][x]
                total, state = total + m * arc.factor + arc.bonus, arc.to
            assert abs(total * table.final[state] - sum(weights) * scale) < 1e-9, clause


def test_toxicity_contractions():
    s = toxicity.Scorer(toxicity.Grammar({"idiot": 4.0}, 0.0))
    assert s.clause("he isn't an idiot") == s.clause("he isn\u2019t an idiot") == s.clause("he is not an idiot") < s.clause("he is an idiot")
    assert s.clause("i won't kill you") == 0 and s.clause("you're an idiot") == s.clause("you re an idiot") and s.clause("l'idiot") == 4.0


def test_toxicity_rows_and_columns(spark):
    rows = [(1, "You are an idiot, an idiot.", 7, "p", 0), (1, "You are an idiot, an idiot.", 7, "p", 0), (2, "fine " * 100_000 + "You idiot. You idiot.", 1, "q", 0), (3, None, 1, "q", 0), (None, "", 1, "q", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string, n_clauses int")
    got = toxicity.score(d, toxicity.Grammar({"idiot": 4.0}, 0.0), threshold=0.5).collect()
    assert sorted((r.doc_id or 0, r.predicted, r.n_clauses) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 0, 0)]
    tie = toxicity.score(d, toxicity.Grammar({"idiot": 4.0}, 0.0), threshold=got[0].score).where("doc_id = 1").collect()
    assert [r.predicted for r in tie] == [1, 1]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    found = [(truth[d], r.predicted) for d, r in got.items() if r.held_out and d in truth]
    assert sum(p for y, p in found if y == 0) == 0 and sum(p for y, p in found if y) / sum(y for y, _ in found) > 0.7


# 3: BPE


def test_bpe_equals_library(spark):
    own, ranks = brute.library()
    texts = [*corpus(3, 60), "a\x1cb", "x\x85y", "  \xa0b", "²x½", "don't'll's", "'sabc", "! 's", "x" * 2000, "ab" * 3000, "\n\n  \t", "日本語テキスト😀", "a" * 257 + " !!!" * 300]
    e = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    ids, ends = e.encode([t or "" for t in texts])
    for t, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == own.encode_ordinary(t or "")
    data, _ = e.decode(ids)
    assert data.tobytes() == "".join(t or "" for t in texts).encode()
    d = docs_of(spark, texts)
    got = bpe.encode_documents(d.withColumnRenamed("doc_id", "ids2").selectExpr("ids2", "text", "1 as ids"), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got.columns == ["ids2", "text", "ids"] and {r.ids2: r.ids for r in got.collect()}[61] == own.encode_ordinary("x\x85y")
    for r in bpe.round_trip(d, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_pair_table():
    rng = np.random.default_rng(0)
    left, right = np.unique(rng.integers(0, 500, (2000, 2)), axis=0).T
    t = bpe.PairTable(left, right, np.arange(len(left), dtype=np.int32))
    assert (t.lookup(left, right) == np.arange(len(left))).all()
    assert (t.lookup(np.array([600, -1]), np.array([1, 2])) == bpe.NONE).all()


# 4: Jaccard join


@pytest.mark.parametrize(("seed", "width", "percent"), [(4, 4, 85), (5, 5, 80)])
def test_jaccard(spark, seed, width, percent):
    texts = corpus(seed)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(140)]
    for _ in range(30):  # copies that link to their base but not to each other
        t = list(base)
        for _ in range(2):
            t[rng.randrange(140)] = f"z{rng.random()}"
        texts.append(" ".join(t))
    texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, texts), width=width, percent=percent).collect()}
    assert got == brute.components(list(enumerate(texts)), width, percent)


def test_jaccard_with_chance_nodes(spark, monkeypatch):
    """Sets that share a node by chance are neither glued together nor lost."""
    whole = jaccard.set_id
    monkeypatch.setattr(jaccard, "set_id", lambda s: (whole(s)[0] & 7, whole(s)[1]))
    texts = corpus(44, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, texts), width=4, percent=85).collect()}
    assert got == brute.components(list(enumerate(texts)), 4, 85)


def test_jaccard_rows_and_stage(spark):
    d = spark.createDataFrame([(2, "A b c", 1), (2, "A b c", 1), (1, "a  B c\n", 2), (3, "", 3), (4, None, 4), (None, "q r", 5)], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(d, width=4, percent=85).collect()), key=lambda x: (x[0] is None, x[0]))
    assert got == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (None, 1, None)]
    kept = jaccard.representatives(d)
    assert kept.columns == d.columns and sorted(r.component_id for r in kept.collect()) == [2, 3, 4, 5]


def test_representatives_of_unclear_ids(spark):
    rng = random.Random(41)
    a, b, c, clean, chain = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(5))
    near = lambda t, k=1: t + "".join(f" more{i}" for i in range(k))
    rows = [(1, a), (5, near(a)), (5, clean), (2, b), (2, b), (None, c), (None, near(c)), (9, c), (3, ""), (3, ""), (None, "")]
    rows += [(20, chain), (None, near(chain, 12)), (21, near(chain, 24))]  # the ends meet only by the row without an id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in jaccard.representatives(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == [(1, a), (2, b), (3, ""), (3, ""), (5, clean), (9, c), (20, chain), (None, "")]


def test_signatures_meet():
    """Linked sets share a signature at every size."""
    rng = np.random.default_rng(0)
    for size in [*range(6, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        while True:
            c = b.copy()
            c[rng.integers(len(c))] = rng.integers(0, 2**63)
            if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                break
            b = np.unique(c)
        if not np.array_equal(a, b):
            owner, s = jaccard.signatures([a, b], 85)
            assert set(s[owner == 0]) & set(s[owner == 1]), size


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    root = {}
    for x in {v for e in edges for v in e}:
        root[x] = x
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


# 5: decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([25, 14, 10, 9, 3, 1, 0])] + [(7, None), (8, "Ünï Wörd " * 6)]
    texts = [item(rng.randint(0, 40)) for _ in range(60)]
    texts += [f"{item(5)} {items[0][1][3:]} {item(4)}", items[1][1].upper(), f"{items[2][1]}!{items[3][1]}", None, "", "ünï wörd " * 8, f"x {items[4][1]} y", items[2][1] + " " + items[2][1]]
    d = docs_of(spark, [*texts, texts[60]], [*range(len(texts)), 60])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.scan(d, b)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, k, found = brute.hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, k, len(found), k > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    kept = decontam.clean(d.selectExpr("doc_id", "text", "1 as hit", "2 as words"), b)
    assert kept.columns == ["doc_id", "text", "hit", "words"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not brute.hits(t, items)[1]]


def test_benchmark_items_without_id(spark):
    b = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (None, "red fox"), (4, "alpha beta gamma")], "item_id long, text string")
    d = docs_of(spark, ["x one two three four five six seven eight nine ten y", "a red fox", "alpha beta gamma red fox", "clean text"], range(4))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.scan(d, b).collect()}
    assert got == {0: (10, []), 1: (2, []), 2: (5, ["4"]), 3: (0, [])}
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [3]


# 6: token store


def test_directly_addressable_codes():
    ids = np.random.default_rng(0).integers(0, 1 << 20, 3000)
    ids[::5] = 7
    levels, bits, ranks = dac.pack(ids)
    assert (dac.unpack(levels, bits) == ids).all() and (dac.access(levels, bits, ranks, np.arange(len(ids))) == ids).all()
    assert len(dac.unpack(*dac.pack(np.zeros(0))[:2])) == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_token_store(spark, special_as_text):
    texts = [*corpus(6, 50), "<|endoftext|> a", "x<|startoftext|><|endoftext|>y z", "<|ENDOFTEXT|>", "İstanbul ΟΔΟΣ", "e ́ x", "a\x85b\x1cc don't 'S"]
    rng = random.Random(2)
    ids = rng.sample(range(-5, 1000), len(texts))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    if special_as_text:
        t.encode_special_tokens = True
    table = dac.write(docs_of(spark, texts, ids), queries.vocabulary("word_bpe_49k.json"), block_tokens=64, special_as_text=special_as_text)
    got = {r.doc_id: r for r in dac.read(table).collect()}
    start, all_ids = 0, []
    for d, x in sorted(zip(ids, texts, strict=True)):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids) == (start, len(want), want)
        start += len(want)
        all_ids += want
    assert all(r.first_id == got[r.doc_id].ids[0] for r in dac.digest(table).collect())
    wanted = [*rng.sample(range(start), 200), 0, 0, start - 1, start, -1, None]
    found = dac.fetch(table, spark.createDataFrame([(p,) for p in wanted], "place long")).collect()
    assert sorted((r.place, r.id) for r in found) == sorted({(p, all_ids[p]) for p in wanted if p is not None and 0 <= p < start})


def test_token_store_without_ids(spark):
    rows = [(None, "b c"), (-(2**63), "a"), (None, "a"), (3, None), (3, "z"), (3, "z")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in dac.read(dac.write(d, queries.vocabulary("word_bpe_49k.json"))).collect())
    assert [x[1] for x in got] == [None, None, -(2**63), 3, 3, 3] and [x[2] for x in got] == [2, 3, 2, 1, 2, 2]


def test_plain_words_need_no_call_each():
    """New words of letters, digits and punctuation are merged in bulk: a call of the library for each made op6 exceed its CPU budget."""
    content = queries.vocabulary("word_bpe_49k.json")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuyzABSÀÖØßÿéñ") for _ in range(rng.randint(1, 64 if rng.random() < 0.02 else 12))).encode()[:64].decode(errors="ignore")
    texts = [rng.choice([" ", "\n", "\r\n\t", "-", "3.14", "_/"]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = [e.ids for e in Tokenizer.from_str(content.decode()).encode_batch(texts, add_special_tokens=False)]
    own = dac.WordTokenizer(content)
    own.tokenizer = SimpleNamespace(model=None, encode_batch=lambda x, **_: [] if not x else pytest.fail("a word went through the library"))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_words_equal_the_library(monkeypatch):
    """Words of all kinds, over spans shorter than texts and caches smaller than the words; long words aren't held."""
    monkeypatch.setattr(dac, "SPAN_BYTES", 60)
    monkeypatch.setattr(dac, "CACHED", 150)
    content = queries.vocabulary("word_bpe_49k.json")
    t, own, rng = Tokenizer.from_str(content.decode()), dac.WordTokenizer(content), random.Random(4)
    chars = [*"abcdestTZÀØßÿÞ×÷ªµ0789!#',.-_~[ \n\t\r\x0b\x0c\x85\x1c\x00\x7f\xa0\u3000\u0301İΣς日\U0001f600ﬁÅ½²٣й", "'s", "'LL", " ", " ", "\n"]
    words = ["x" * 65, "é" * 40, "!" * 80, "7" * 70, "日" * 50, "BY-NC", "(4.0)", "it's", "café,", "international"]
    for _ in range(60):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(10)] + ["", " ".join(rng.choices(words, k=rng.randint(0, 30))), "\n \t"]
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert own.old and max(map(len, [*own.known, *own.old])) <= dac.WIDEST
    assert own.encode([]) == [] and own.encode([""]) == [b""] and own.encode([" \n"]) == [b""]


def test_other_tokenizer_file():
    """A file with other steps goes through the library as a whole."""
    content = queries.vocabulary("byte_bpe_50k.json")
    texts = ["a  b\n c", "Don't <|endoftext|> x", ""]
    t = Tokenizer.from_str(content.decode())
    for x, ids in zip(texts, dac.WordTokenizer(content).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


# 7: language


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(d.where("doc_id % 2 = 0"), max_docs=300)
    more = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !?", "en"), (-4, "the of and " * 20_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d.where("doc_id % 2 = 1").unionByName(more).selectExpr("*", "1 as score"), model).collect()}
    assert [got[-k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[-4].lang_pred == "en" and got[-1].score == 0
    rest = [r for k, r in got.items() if k >= 0]
    assert sum(r.lang_pred == r.lang for r in rest) / len(rest) > 0.98 and all(0 <= r.score <= 1 for r in rest)


def test_language_equals_plain_bayes(spark):
    """Against naive Bayes over dictionaries; ties, repeated rows and clashing columns."""
    rng = random.Random(7)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 30)))
    rows = [(i, make("abcdeé"), "aa") for i in range(40)] + [(40 + i, make("cdefgß"), "bb") for i in range(25)] + [(70 + i, make("日本語xyz"), "cc") for i in range(10)]
    rows += [(90, None, "aa"), (91, "abc", None), (92, "12", "bb"), (93, "abé " * 3000, "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    buckets, smoothing = 64, 0.1
    model = langid.train(frame, buckets=buckets, smoothing=smoothing)

    def grams(t):
        t = f" {t.lower()} "
        for n in (2, 3):
            for i in range(len(t) - n + 1):
                code = n
                for c in t[i : i + n]:
                    code = (code * 0x100000001B3 + ord(c)) % 2**64
                yield int(langid.mix64(np.array([code], np.uint64))[0]) % buckets

    counts = {x: Counter() for x in ("aa", "bb", "cc")}
    size = Counter()
    for _, t, x in rows:
        if t is not None and x is not None:
            counts[x].update(grams(t))
            size[x] += 1
    texts = ["abé dé", "fgß", "日本 xy", "cd cd", "e", *(t for _, t, _ in rows[:75:5])]
    more = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate([*texts, *texts[:3], None, "", "12"])], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.predict(more, model).collect()}
    assert len(got) == len(texts) + 6
    for i, t in enumerate([*texts, *texts[:3]]):
        logs = {x: math.log(size[x] / sum(size.values())) + sum(math.log((c[g] + smoothing) / (sum(c.values()) + smoothing * buckets)) for g in grams(t)) for x, c in counts.items()}
        top = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(v - logs[top]) for v in logs.values())
        assert got[i].lang_pred == top and abs(got[i].score - share) < 1e-3
    assert all(got[len(texts) + k].lang_pred == "und" for k in (3, 4, 5))
    tie = langid.LanguageModel(["p", "q"], np.zeros((2, buckets), np.float32), np.log([0.5, 0.5]), (2, 3))
    assert langid.score_texts(["some text"], tie)[0] == ["p"]
    with pytest.raises(ValueError):
        langid.train(frame, max_languages=2)


# 8: chat


def test_chat_rows_and_columns(spark):
    """Other columns don't clash; a repeated row is a turn of its own."""
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (4, 0, "user", "w " * 50_000)]
    d = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, n_turns long, rendered string, n string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(d).collect()}
    assert set(got) == {1, 2, 4} and got[2][0] == 3 and got[2][1].count("a<|end|>") == 2


def test_chat_collapse(spark):
    rng = random.Random(8)
    convs = {i: [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yo", None, ""])) for _ in range(rng.randint(1, 4))] for i in range(60)}
    rows = [(c, n, r, t) for c, turns in convs.items() for n, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    prefixes = {tuple(t[:k]) for t in convs.values() for k in range(1, len(t))}
    first = {}
    for c, t in sorted(convs.items()):
        first.setdefault(tuple(t), c)
    assert set(got) == {c for t, c in first.items() if t not in prefixes}
    for c, r in got.items():
        assert r.rendered == "".join(f"<|{a or 'unknown'}|>\n{b or ''}<|end|>\n" for a, b in convs[c]) and r.n_turns == len(convs[c])


# 9: pages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=1>Home</a></nav>
<div class="cookie-notice"><p>We use cookies on this long and winding site, accept them all.</p></div>
<div id=wrap><article><h1>Title &amp; more</h1><p>First <b>bold</b>text with   spaces,
and a line. <a href="/x">A link</a> follows.<p>Second<br>paragraph &eacute; &#8212; end.</p><ul><li>one<li>two</ul>
<script>var a = "</p>";</script><aside>Related</aside><div class="ad">Buy</div></article>
<div class="sidebar"><p>Side text of some length that is not the article.</p></div></div>
<section class="comments"><p>I think this article is very good indeed, thank you.</p></section><form><p>Mail</p></form><footer>Foot</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title & more\n\nFirst boldtext with spaces, and a line. A link follows.\n\nSecond paragraph é — end.\n\none\n\ntwo"
    bare = PAGE.replace("<article>", "<div class=c>").replace("</article>", "</div>")
    assert htmltext.main_text(bare) == htmltext.main_text(PAGE)
    for empty in (None, "", "<html></html>", "<script>x</script>", "<!-- x"):
        assert htmltext.main_text(empty) == ""
    assert htmltext.main_text("a < b &amp; c") == "a < b & c" and htmltext.main_text("<p>hi") == "hi"
    long = "<article>" + "<p>word word word</p>" * 5000 + "</article>"
    assert htmltext.main_text(long).count("\n\n") == 4999
    assert htmltext.main_text("<div>" * 3000 + "deep") == "deep"


TEXT = "The river rose by two metres in the night, and the old bridge was closed to all traffic until noon. " * 4


@pytest.mark.parametrize("wrapper", ['<div class="content with-sidebar">', '<div class="no-comments">', '<div id="search-page">'])
def test_wrappers_named_like_boilerplate(wrapper):
    ad, aside = '<div class="ad"><p>Buy cheap shoes now.</p></div>', '<div class="sidebar"><p>Weather and sports of today.</p></div>'
    comment = f'<div class="comments"><article class="comment"><p>{TEXT * 2}</p></article></div>'
    for body in (f"<article><p>{TEXT}</p></article>", f"<p>{TEXT}</p>"):
        page = f"<html><body>{aside}{wrapper}{ad}{body}</div></body></html>"
        assert htmltext.main_text(page) == TEXT.strip()
    # long comments beside the article are cut as before
    assert htmltext.main_text(f"<body>{wrapper}<article><p>{TEXT}</p></article>{comment}</div></body>") == TEXT.strip()
    assert htmltext.main_text(f"<body><article><p>{TEXT}</p></article>{comment}</body>") == TEXT.strip()


@pytest.mark.parametrize("name", ["layout has-sidebar", "search-engine-history", "legal-analysis", "share-price", "nav-open page", "related-work", "article-form", "advert comments"])
def test_no_page_is_emptied_by_class_words(name):
    page = f'<body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div class="{name}"><p>{TEXT}</p><div class="share-box">Share</div><p>{TEXT}</p></div><footer>c</footer></body>'
    assert htmltext.main_text(page) == f"{TEXT.strip()}\n\n{TEXT.strip()}"
    assert htmltext.main_text("<div class=ad>" * 20_000 + "deep") == "deep"


def test_density_of_every_node():
    """Counts, densities and sums of each node against plain recounts of its subtree."""
    rng = random.Random(9)
    for _ in range(30):
        parts = []
        for _ in range(40):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<nav>", "</nav>", '<div class="ad">', "word and word ", "x", "<br>", "<article>", "</article>", "<script>var x</script>"]))
        root = htmltext.parse("".join(parts))
        order = htmltext.measure(root)

        def below(x):
            return [y for c in x.items if isinstance(c, htmltext.Node) for y in [c, *below(c)]]

        def chars(x):
            return sum(len(c.replace(" ", "")) if isinstance(c, str) else chars(c) for c in x.items if x.tag not in htmltext.RAW)

        assert {id(x) for x in order} == {id(x) for x in [root, *below(root)]}
        page_links = sum(chars(x) for x in order if x.tag == "a" and not any(x in below(y) for y in order if y.tag == "a"))
        for x in order:
            links = [y for y in below(x) if y.tag == "a"]
            outer = [y for y in links if not any(y in below(z) for z in links)]
            n, tags, m = chars(x), len(below(x)), sum(map(chars, outer))
            assert (x.chars, x.tags, x.link_chars, x.link_tags) == (n, tags, m, len(links))
            want = 0.0
            if n:
                r = math.log(n / max(n - m, 1) * m + page_links / max(chars(root), 1) * n + math.e)
                want = n / max(tags, 1) * math.log(max(n / max(m, 1) * max(tags, 1) / max(len(links), 1), 1) + 1, max(r, 1.0001) + 1) * (1 - m / n)
            assert abs(x.density - want) < 1e-9
            kids = [c for c in x.items if isinstance(c, htmltext.Node)]
            assert abs(x.total - sum(c.density * c.weight for c in kids)) < 1e-9
        core, _ = htmltext.choose(htmltext.parse("".join(parts)))
        best = max(x.total for x in order)
        assert core.total == 0 or abs(core.total - best) < 1e-9


def test_extract_replaces_clashing_columns(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "old", "many", 5)], "page_id long, url string, html string, text string, n_chars string, density int")
    got = htmltext.extract(d).first()
    assert got.n_chars == len(got.text) > 50 and got.density == 5


def test_extract_keeps_columns(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = htmltext.extract(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.where("page_id = 1 and n_chars > 50").count() == 2 and got.where("text = ''").count() == 1


# 10: repeated strings


@pytest.mark.parametrize(("seed", "at_a_time", "block"), [(10, None, None), (11, 5, 500), (12, 40, 1500)])
def test_repeated_strings(spark, monkeypatch, seed, at_a_time, block):
    """Also with pieces and blocks so small that grams cross boundaries of pieces and repeat beyond their block."""
    if at_a_time:
        monkeypatch.setattr(suffixes, "SORTED", at_a_time)
        monkeypatch.setattr(suffixes, "TOLD", 3)
        monkeypatch.setattr(suffixes, "blocks", lambda batches, column="text": blocks.blocks(batches, column, block))
    texts = [*corpus(seed, 120), "yz" * 3000, "x" * 100, "x" * 99]
    d = [(i * 7 % len(texts), t) for i, t in enumerate(texts)] + [(None, texts[0])]
    again = [d[3], d[-2], d[-2], *d[:20]]  # rows that repeat a document
    rows = suffixes.digest(spark.createDataFrame(d + again, "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(d) + len(again) and all(got[r.doc_id] == r for r in rows)
    for i, (raw, hit) in brute.cleaned(d, 100).items():
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        runs = sum(1 for k, h in enumerate(hit) if h and not (k and hit[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_remove_keeps_rows_and_columns(spark):
    d = spark.createDataFrame([(1, "a" * 50, "p", 1), (2, "b c" * 50, "q", 2), (3, "b c" * 50, "r", 3), (4, None, "s", 4), (2, "b c" * 50, "q", 2)], "doc_id long, text string, place string, copy int")
    got = suffixes.remove(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 2, 4]


def test_multikey_order():
    rng = np.random.default_rng(0)
    for n, high, depth in ((500, 3, 6), (2000, 2**63, 2), (300, 1, 4), (17, 2, 1), (1, 5, 3), (0, 5, 3)):
        words = rng.integers(0, high, (n, depth)).astype(np.uint64)
        order = suffixes.multikey_order(words)
        assert sorted(order.tolist()) == list(range(n)) and words[order].tolist() == sorted(words.tolist())


def test_repeats_in_long_text(spark, monkeypatch):
    """A passage that a long text holds at the cut between two stretches."""
    monkeypatch.setattr(suffixes, "STEP", 4096)
    monkeypatch.setattr(suffixes, "LONG", 10_000)
    monkeypatch.setattr(suffixes, "blocks", lambda batches: blocks.blocks(batches, "text", 5000))
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    rows = [(0, long), *((i + 1, long[at : at + 123]) for i, at in enumerate([*range(3900, 4200, 7), *range(8100, 8250, 11)]))]
    got = {r.doc_id: r.n_removed for r in suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 0 if d == 0 else 123 for d, _ in rows}


def test_anchors_across_stretches():
    raw = np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8)
    for got, want in zip(suffixes._long_anchors(raw.tobytes(), 100, 700), suffixes.anchors(raw, np.array([5000]), 100), strict=True):
        assert (got == want).all()


def test_anchors_of_long_text():
    raw = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.anchors(raw, np.array([5000]), 100)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[2], whole[3], strict=True)])
    assert (covered == np.arange(4901)).all() and ((whole[1] >= whole[3]) & (whole[1] <= whole[2] + 68)).all()


