"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import (
    chat,
    checks,
    decontaminate,
    htmltext,
    lexical,
    licenses,
    merkle,
    quality,
    simhash,
    streambpe,
    tokencount,
    topk,
    toxicity,
    triejoin,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op9_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streambpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.jaccard_groups(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_perspectives": op1_perspectives,
    "op2_decontaminate": op2_decontaminate,
    "op3_top_k": op3_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_stream_bpe": op9_stream_bpe,
    "op10_html_text": op10_html_text,
    "op11_ngram_join": op11_ngram_join,
    "op12_ranked_search": op12_ranked_search,
    "op13_manifest": op13_manifest,
}

ASCII_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
x AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
WHERE n <= 20
"""

PERSPECTIVES = """
WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, role AS who, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
s AS (
  SELECT t.conv_id, perspective, turn, who, r, text, coalesce(who = perspective, false) AS own,
    CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN who = perspective OR who = 'system' THEN NULL ELSE who END AS name
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS stop
  FROM g
  WINDOW w AS (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, who NULLS FIRST, text, r ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, name, segment, stop - length(segment) AS start, stop AS "end",
  CASE WHEN own THEN stop - length(segment) + length(head) END AS mask_start, CASE WHEN own THEN stop - 1 END AS mask_end
FROM o
"""

ORACLES = {
    "op1_perspectives": PERSPECTIVES,
    "op2_decontaminate": CONTAMINATION,
    "op3_top_k": TOP_K,
    "op11_ngram_join": checks.NGRAM_JOIN,
    "op12_ranked_search": checks.RANKED,
    "op13_manifest": checks.MANIFEST,
}
