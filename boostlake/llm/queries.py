"""Registered queries of the corpus operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlake.llm import bpe, chat, dac, decontam, htmltext, jaccard, langid, quality, suffixes, toxicity

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("BOOSTLAKE_TOKENIZERS", os.path.dirname(public_tokenizers.__file__))


def vocabulary(name: str) -> bytes:
    """Content of a vocabulary file, read on the driver."""
    with open(os.path.join(TOKENIZERS, name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality.log_ratios(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, ratios)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = toxicity.held_out(F.col("doc_id"))
    grammar = toxicity.learn(docs.where(~own), table(spark, sf_dir, "labels").where(~own))
    return toxicity.score(docs.withColumn("held_out", own), grammar, keep=["doc_id", "held_out"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.digest(dac.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), model, keep=["doc_id", "held_out"])


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"), length=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_token_store": op6_token_store,
    "op7_langid": op7_langid,
    "op8_chat": op8_chat,
    "op9_main_text": op9_main_text,
    "op10_repeated_strings": op10_repeated_strings,
}
ORACLES: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 0) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS component FROM r GROUP BY node) m USING (doc_id)""",
    "op5_decontamination": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i + 1 : i + least(10, len(words))], ' ') AS win FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS i FROM b WHERE len(words) > 0)),
        dw AS (SELECT doc_id, i, n, array_to_string(words[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_chat": r"""
        WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n_turns, list(md5(coalesce('r' || role, 'n') || chr(0) || coalesce('t' || text, 'n')) ORDER BY n) AS h,
                     string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY n) AS rendered FROM t GROUP BY conv_id),
        p AS (SELECT DISTINCT n, h[1:n] AS h FROM (SELECT h, unnest(range(1, n_turns)) AS n FROM c)),
        f AS (SELECT h, min(conv_id) AS conv_id FROM c GROUP BY h)
        SELECT c.conv_id, c.n_turns, CAST(length(rendered) AS BIGINT) AS n_chars, rendered FROM c JOIN f USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = c.h)""",
}
