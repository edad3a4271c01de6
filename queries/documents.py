"""Masking of the text tables with statistics, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans.masking import analyze_text, mask_with_stats
from cloakframe.plans.policy import Policy, Rule
from queries.sqlkit import (
    ALL_TEXTS_SQL,
    DETECTORS,
    PREFIXES,
    SECRET,
    all_texts,
    counts_text,
    hmac_sql,
    masked_sql,
    prefix_case,
    resolved_ctes,
    stats_sql,
    table,
)

_TOKEN = f"({prefix_case('detector', PREFIXES)} || '_' || substr({hmac_sql('v')}, 1, 24))"


def _masked(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("text", "masked").withColumn("detector_counts", counts_text())


def _mask_sql(texts: str, key: str, mask: str = _TOKEN, detectors: tuple[str, ...] = DETECTORS) -> str:
    return f"""
WITH {resolved_ctes(texts, *detectors)}, stats AS ({stats_sql()}), masked AS ({masked_sql(mask)})
SELECT s.key AS {key}, m.masked, s.matches_found, s.matches_applied, s.matches_skipped, s.detector_counts
FROM stats s JOIN masked m ON m.key = s.key"""


def _mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _masked(mask_with_stats(docs, Policy.default(SECRET)))


def _mask_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return _masked(mask_with_stats(pages, Policy.default(SECRET)))


def _mask_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("turn_key"), "text"
    )
    return _masked(mask_with_stats(turns, Policy.default(SECRET)))


def _mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(mask_with_stats(all_texts(spark, sf_dir), Policy.default(SECRET)))


def _analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = analyze_text(all_texts(spark, sf_dir), Policy.default(SECRET))
    return stats.withColumn("detector_counts", counts_text())


_MIXED = {
    "email": Rule(mode="partial"),
    "ip_address": Rule(mode="redact", prefix="IP"),
    "url": Rule(mode="redact"),
    "phone": Rule(mode="hmac"),
    "inn": Rule(mode="hmac", prefix="TAX"),
    "guid": Rule(enabled=False),
}


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(mask_with_stats(all_texts(spark, sf_dir), Policy(SECRET, rules=_MIXED)))


_PARTIAL_EMAIL = (
    "CASE WHEN strpos(v, '@') - 1 > 2 THEN substr(v, 1, 2) ELSE '' END || '***' || substr(v, CAST(strpos(v, '@') AS INTEGER))"
)
_MIXED_SQL = (
    f"CASE detector WHEN 'email' THEN {_PARTIAL_EMAIL} WHEN 'ip_address' THEN 'IP_REDACTED' WHEN 'url' THEN 'URL_REDACTED' "
    f"ELSE CASE detector WHEN 'inn' THEN 'TAX' ELSE 'PHONE' END || '_' || substr({hmac_sql('v')}, 1, 24) END"
)

QUERIES = {
    "mask_documents": _mask_documents,
    "mask_pages": _mask_pages,
    "mask_conversations": _mask_conversations,
    "mask_with_stats": _mask_all,
    "analyze_text": _analyze,
    "mask_mixed_modes": _mixed,
}
ORACLES = {
    "mask_documents": _mask_sql("SELECT doc_id AS key, text FROM documents", "doc_id"),
    "mask_pages": _mask_sql("SELECT page_id AS key, html AS text FROM pages", "page_id"),
    "mask_conversations": _mask_sql("SELECT conv_id || '/' || turn AS key, text FROM conversations", "turn_key"),
    "mask_with_stats": _mask_sql(ALL_TEXTS_SQL, "key"),
    "analyze_text": f"WITH {resolved_ctes(ALL_TEXTS_SQL, *DETECTORS)} {stats_sql()}",
    "mask_mixed_modes": _mask_sql(
        ALL_TEXTS_SQL, "key", _MIXED_SQL, tuple(d for d in _MIXED if d != "guid")
    ),
}
