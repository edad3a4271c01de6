"""Mapping of tokens to values, restoring, token cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.maskers import hmac_sha256
from cloakframe.operators import mapping as m
from cloakframe.operators import restore
from cloakframe.operators.fields import mask_table
from cloakframe.plans.extend import register_detector
from cloakframe.plans.masking import mask_with_stats
from cloakframe.plans.policy import Policy, Rule
from cloakframe.session import shared_folder
from queries.sqlkit import (
    ALL_TEXTS_SQL,
    DETECTORS,
    K,
    PASSPHRASE,
    PREFIXES,
    SECRET,
    all_texts,
    hmac_sql,
    prefix_case,
    resolved_ctes,
    table,
    token_sql,
)
from queries.tables import people

_POLICY = Policy.default(SECRET)
_PREFIXES = list(PREFIXES.values())
_CTES = resolved_ctes(ALL_TEXTS_SQL, *DETECTORS)
_TOKEN = f"({prefix_case('detector', PREFIXES)} || '_' || substr({hmac_sql('v')}, 1, 24))"


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.build_mapping(all_texts(spark, sf_dir), _POLICY)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two encrypted generations, written and read back; the second knows the pages only."""
    path = shared_folder(spark, "mapping")
    m.save_mapping(_build(spark, sf_dir), path, PASSPHRASE, 0)
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    m.save_mapping(m.build_mapping(pages, _POLICY), path, PASSPHRASE, 1)
    return m.load_mapping(spark, path, PASSPHRASE)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping mappings of customers that disagree where both have a token."""
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T_"), F.col(K).cast("string")).alias("token"), F.col("c_name").alias("value"), K
    )
    stored = rows.where(F.col(K) % 3 != 0).select("token", "value")
    own = rows.where(F.col(K) % 3 != 1).select("token", F.concat("value", F.lit("!")).alias("value"))
    return stored, own


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_mapping(*_halves(spark, sf_dir))


def _merge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, own = (
        df.select(hmac_sha256(F.col("token"), SECRET).alias("digest"), F.col("value").alias("token"))
        for df in _halves(spark, sf_dir)
    )
    return m.merge_token_cache(stored, own)


def _stored(df: DataFrame) -> DataFrame:
    """Written once and read back, as masked data and mappings are before anything is restored."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _masked_and_mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All texts masked, and their mapping, each written once and read back as stored ones are."""
    texts = all_texts(spark, sf_dir)
    masked = mask_with_stats(texts, _POLICY).select("key", "text", "matches_applied")
    return _stored(masked), _stored(m.build_mapping(texts, _POLICY))


def _demask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask all texts and restore them: the originals come back, every token replaced."""
    return m.demask(*_masked_and_mapped(spark, sf_dir), _PREFIXES)


def _demask_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which a third has no key and the others share one."""
    key = F.when(F.col(K) % 3 != 0, F.lit("file"))
    lines = table(spark, sf_dir, "customer").select(K, key.alias("key"), F.expr(f"'mail u' || {K} || '@mail.ru'").alias("text"))
    masked = mask_with_stats(lines, _POLICY).select(K, "key", "text")
    return m.demask(_stored(masked), _stored(m.build_mapping(lines, _POLICY)), _PREFIXES)


def _demask_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts masked with tokens of an earlier run's cache, restored by the mapping of the same arguments."""
    texts, policy, held = _cached_texts(spark, sf_dir), _cache_policy(), _held_cache(spark, sf_dir)
    masked = m.mask_with_cache(texts, policy, K, cache=held)
    known = m.build_mapping(texts, policy, cache=held, order=[K])
    return m.demask(_stored(masked), _stored(known), [*policy.hmac_prefixes().values(), "LOGIN"])


# A text with tokens that are mapped, not mapped, and mapped under the shorter of two prefixes.
_NAME_TOKEN = token_sql("c_name", "CODE")


def _demask_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    token = m.token_of(hmac_sha256(F.col("c_name"), SECRET), F.lit("CODE"))
    known = customers.where(F.col(K) % 2 == 0).select(token.alias("token"), F.col("c_name").alias("value"))
    texts = customers.select(
        K, F.concat(F.lit("a "), token, F.lit("f, DOCUMENT_"), token, F.lit(" x"), token, token).alias("text")
    )
    return m.demask(texts, known, ["CODE", "DOCUMENT_CODE"])


def _demask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir).select(K, "contact", "comment", "formula", "c_acctbal")
    values = F.explode(F.array("contact", "comment", "formula")).alias("text")
    known = m.build_mapping(rows.select(values), _POLICY)
    masked = mask_table(rows, _POLICY, skip_formulas=True)
    return m.demask_table(_stored(masked), _stored(known), _PREFIXES, K)


def _demask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.operators.reports import demask_report

    masked, known = _masked_and_mapped(spark, sf_dir)
    return demask_report(m.demask(masked, known, _PREFIXES), known)


def _demask_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small mapping with keys of any shape; the longer key wins."""
    known = {"Customer#": "C-", "Customer": "client", "#00000000": "no. ", "(": "["}
    restored = m.demask_with_keys(F.concat(F.lit("("), F.col("c_name"), F.lit(" Customer")), known)
    return table(spark, sf_dir, "customer").select(K, restored.alias("r")).select(K, "r.text", "r.replacements")


def _demask_any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of keys of any shape: names, single characters, keys that begin or end like others."""
    customers = table(spark, sf_dir, "customer")
    named = customers.select(F.col("c_name").alias("token"), F.concat(F.lit("no. "), F.col(K).cast("string")).alias("value"))
    starts = customers.select(F.expr("substr(c_name, 1, 14)").alias("token"), F.lit("some").alias("value"))
    few = spark.createDataFrame([("(", "["), ("Customer", "client"), ("é\U0001f600", "smile"), ("r and ", "E&")], "token string, value string")
    other = F.concat(F.lit("Customer#99999"), F.lpad(F.col(K).cast("string"), 9, "0"))
    text = F.concat(F.lit("("), F.col("c_name"), F.lit(" é\U0001f600 Customer and "), other, F.lit("("))
    return restore.demask_any_keys(customers.select(K, text.alias("text")), named.unionByName(starts).unionByName(few))


# Token cache: the same value found by two detectors gets the token of the first place it is met at.
_DIGITS = f"'0' || lpad(cast({K} as string), 8, '0')"
_CACHE_EXPR = (
    f"CASE WHEN {K} % 2 = 0 THEN 'БИК ' || {_DIGITS} ELSE 'код 1' || lpad(cast({K} as string), 8, '0') END || "
    f"' and u' || cast({K} % 50 as string) || '@mail.ru'"
)


def _cache_policy() -> Policy:
    return Policy.only(SECRET, "bik", "kpp", "email")


def _cached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(K, F.expr(_CACHE_EXPR).alias("text"))


def _held_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of an earlier run that knew some of the addresses as logins."""
    mails = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(
        F.expr("'u' || cast(n_nationkey as string) || '@mail.ru'").alias("value")
    )
    digest = hmac_sha256(F.col("value"), SECRET)
    return mails.select(digest.alias("digest"), F.concat(F.lit("LOGIN_"), F.substring(digest, 1, 24)).alias("token"))


def _mask_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mask_with_cache(_cached_texts(spark, sf_dir), _cache_policy(), K, cache=_held_cache(spark, sf_dir))


# The same number is a code in one text and, being an address, an address in the next.
_SHARED = f"'u' || cast({K} div 2 as string) || '.x9@mail.ru'"
_TWO_EXPR = f"CASE WHEN {K} % 2 = 0 THEN '<' || {_SHARED} || '>' ELSE 'to ' || {_SHARED} END"


def _first_prefix_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values met by two detectors in one run: the prefix seen first is used everywhere."""
    texts = table(spark, sf_dir, "customer").select(K, F.expr(_TWO_EXPR).alias("text"))
    policy = register_detector(
        Policy.only(SECRET, "email"), "bracketed", r"<([^>]+@[^>]+)(?=>)", group=1, priority=99, rule=Rule(prefix="BOX")
    )
    return m.mask_with_cache(texts, policy, K)


def _cache_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a few shared keys, each with many digests to look up."""
    rows = table(spark, sf_dir, "customer").select(K, "c_mktsegment", F.expr(_CACHE_EXPR).alias("text"))
    return m.mask_with_cache(rows, _cache_policy(), "c_mktsegment", order=[K], cache=_held_cache(spark, sf_dir))


def _folded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of many generations, of which some are saved again, others folded: the newest values."""
    path = shared_folder(spark, "mapping")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T_"), (F.col(K) % 500).cast("string")).alias("token"), F.col("c_name").alias("value"), (F.col(K) % 5).alias("g")
    )
    part = lambda g: rows.where(F.col("g") == g).groupBy("token").agg(F.min("value").alias("value"))
    for generation in range(5):
        m.save_mapping(part(generation), path, PASSPHRASE, generation)
        if generation == 2:
            m.compact_mapping(spark, path)
    m.save_mapping(part(0).withColumn("value", F.lit("late")), path, PASSPHRASE, 0)  # folded by now: stays
    m.save_mapping(part(4), path, PASSPHRASE, 4)
    return m.load_mapping(spark, path, PASSPHRASE)


_MAIL = f"'u' || ({K} % 50) || '@mail.ru'"

QUERIES = {
    "build_mapping": _build,
    "mapping_store": _store,
    "merge_mapping": _merge,
    "merge_token_cache": _merge_cache,
    "demask": _demask,
    "demask_null_keys": _demask_null_keys,
    "demask_cached_tokens": _demask_cached,
    "demask_partial_mapping": _demask_parts,
    "demask_table": _demask_table,
    "demask_report": _demask_report,
    "demask_with_keys": _demask_keys,
    "demask_any_keys": _demask_any_keys,
    "mask_with_cache_by_segment": _cache_by_segment,
    "mapping_store_folded": _folded_store,
    "mask_with_cache": _mask_with_cache,
    "cache_first_prefix_wins": _first_prefix_wins,
}
_MAPPING_SQL = f"WITH {_CTES} SELECT DISTINCT {_TOKEN} AS token, v AS value FROM kept"
_MERGED = f"""
SELECT CASE WHEN {K} % 3 = 1 THEN c_name ELSE c_name || '!' END AS value, 'T_' || {K} AS token FROM customer"""
ORACLES = {
    "build_mapping": _MAPPING_SQL,
    "mapping_store": _MAPPING_SQL,
    "merge_mapping": _MERGED,
    "merge_token_cache": f"SELECT {hmac_sql('token')} AS digest, value AS token FROM ({_MERGED})",
    "demask": f"""
WITH {_CTES}
SELECT t.key, t.text, coalesce(k.n, 0) AS matches_applied, coalesce(k.n, 0) AS replacements
FROM texts t LEFT JOIN (SELECT key, count(*) AS n FROM kept GROUP BY key) k ON k.key = t.key""",
    "demask_null_keys": f"""
SELECT {K}, CASE WHEN {K} % 3 <> 0 THEN 'file' END AS key, 'mail u' || {K} || '@mail.ru' AS text, 1 AS replacements FROM customer""",
    "demask_cached_tokens": f"SELECT {K}, {_CACHE_EXPR} AS text, 2 AS replacements FROM customer",
    "demask_partial_mapping": f"""
SELECT {K}, CASE WHEN {K} % 2 = 0 THEN 'a ' || c_name || 'f, DOCUMENT_' || c_name || ' x' || c_name || c_name
  ELSE 'a ' || t || 'f, DOCUMENT_' || t || ' x' || t || t END AS text, CASE WHEN {K} % 2 = 0 THEN 4 ELSE 0 END AS replacements
FROM (SELECT {K}, c_name, {_NAME_TOKEN} AS t FROM customer)""",
    "demask_table": f"""
SELECT {K}, 'u' || {K} || '@mail.ru' AS contact, 'call u' || {K} || '@mail.ru from 10.0.0.' || ({K} % 256) AS comment,
  CASE WHEN {K} % 2 = 0 THEN '=' ELSE '' END || 'A1 & 10.0.0.' || ({K} % 256) AS formula, c_acctbal,
  CASE WHEN {K} % 2 = 0 THEN 3 ELSE 4 END AS replacements FROM customer""",
    "demask_report": f"""
WITH {_CTES}
SELECT (SELECT count(*) FROM kept) AS replacements, (SELECT count(DISTINCT {_TOKEN}) FROM kept) AS mapping_size""",
    "demask_with_keys": f"""
SELECT {K}, replace(replace(replace(replace('(' || c_name || ' Customer', 'Customer#', chr(1)), 'Customer', 'client'), chr(1), 'C-'), '(', '[') AS text,
  3 AS replacements FROM customer""",
    "mask_with_cache": f"""
SELECT {K}, CASE WHEN {K} % 2 = 0 THEN 'БИК ' || {token_sql(_DIGITS, 'BIK')}
    ELSE 'код ' || {token_sql(f"'1' || lpad(cast({K} as string), 8, '0')", 'KPP')} END
  || ' and ' || CASE WHEN {K} % 50 < (SELECT count(*) FROM nation) AND {K} % 50 % 2 = 0 THEN {token_sql(_MAIL, 'LOGIN')}
    ELSE {token_sql(_MAIL, 'EMAIL')} END AS text FROM customer""",
    "mask_with_cache_by_segment": f"""
SELECT {K}, c_mktsegment, CASE WHEN {K} % 2 = 0 THEN 'БИК ' || {token_sql(_DIGITS, 'BIK')}
    ELSE 'код ' || {token_sql(f"'1' || lpad(cast({K} as string), 8, '0')", 'KPP')} END
  || ' and ' || CASE WHEN {K} % 50 < (SELECT count(*) FROM nation) AND {K} % 50 % 2 = 0 THEN {token_sql(_MAIL, 'LOGIN')}
    ELSE {token_sql(_MAIL, 'EMAIL')} END AS text FROM customer""",
    "demask_any_keys": f"""
SELECT {K}, '[no. ' || {K} || ' smile client and client#99999' || lpad({K}::VARCHAR, 9, '0') || '[' AS text, 6 AS replacements FROM customer""",
    "mapping_store_folded": f"""
SELECT 'T_' || ({K} % 500) AS token, min(c_name) AS value FROM customer GROUP BY {K} % 500""",
    "cache_first_prefix_wins": f"""
SELECT {K}, CASE WHEN {K} % 2 = 0 THEN '<' || t || '>' ELSE 'to ' || t END AS text
FROM (SELECT {K}, {token_sql(f"'u' || ({K} // 2) || '.x9@mail.ru'", 'BOX')} AS t FROM customer)""",
}
