"""The pipeline against the plain versions of its stages, on a small mixed corpus."""

import hashlib

import pytest

import corpus_pipeline
from boostlake.llm import langid
from boostlake.llm.blocks import durable

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, from all documents and some awkward rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "1234 5678", "en", "s", 9)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, f in corpus_pipeline.STAGES:
        out.append(durable(f(spark, out[-1], DATA), name))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_language_stage(spark, stages):
    kept = {d for d, _ in rows(stages[1])}
    model = langid.train(stages[0].where("doc_id is not null and lang is not null"))
    assert not kept & {10**9, 10**9 + 1, 10**9 + 2}
    names, score = langid.score_texts([t for _, t in rows(stages[1])], model)
    assert all(n != "und" for n in names) and len(kept) >= 0.95 * (stages[0].count() - 3) and score.min() > 0.4


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    want = brute.components(before, 5, 80)
    assert sorted(d for d, _ in rows(stages[2])) == sorted(d for d, (_, c) in want.items() if d == c)


def test_repeated_string_stage(stages):
    want = {}
    for d, (raw, hit) in brute.cleaned(rows(stages[2]), 100).items():
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h).decode(errors="ignore")
        if not any(hit) or kept.strip(" "):
            want[d] = kept
    assert dict(rows(stages[3])) == want


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(rows(stages[4])) == sorted((d, t) for d, t in rows(stages[3]) if not brute.hits(t, items)[1])


def test_token_stage(stages):
    own, _ = brute.library()
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
