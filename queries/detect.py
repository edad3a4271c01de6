"""One query per detector: its spans in all texts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans.extend import register_detector
from cloakframe.plans.masking import findings, mask_with_stats
from cloakframe.plans.policy import Policy, Rule
from queries.sqlkit import ALL_TEXTS_SQL, K, SECRET, SPANS, all_texts, num, spans_sql, table


def _rows(found: DataFrame, key: str = "key") -> DataFrame:
    return found.select(
        key,
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        "value",
    )


def _detect(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(findings(all_texts(spark, sf_dir), Policy.only(SECRET, name), with_value=True))


def _detect_sql(name: str) -> str:
    return (
        "SELECT key, s AS span_start, e AS span_end, v AS value "
        f"FROM ({spans_sql(ALL_TEXTS_SQL, name)})"
    )


QUERIES = {f"detect_{name}": partial(_detect, name) for name in SPANS}
ORACLES = {f"detect_{name}": _detect_sql(name) for name in SPANS}

# Document codes: markers in several scripts and cases, codes with and without a digit.
_CODE = f"'ЗК' || {num(K, 6)} || CASE WHEN {K} % 3 = 0 THEN '/ИП-' ELSE '.z_' END || cast({K} % 7 as string)"
CODE_EXPR = (
    f"'Код=' || {_CODE} || ', договор №' || CASE WHEN {K} % 2 = 0 THEN 'ABCDEFG' ELSE 'ABC' || {num(K, 4)} END"
    f" || ' от 01.02.2026; valid ' || {num(K, 6)} || 'x, document : ' || {num(K, 9)} || ' ID #A' || {num(K, 5)}"
)


def _detect_document_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(K, F.expr(CODE_EXPR).alias("text"))
    return _rows(findings(texts, Policy.only(SECRET, "document_code"), with_value=True), K)


QUERIES["detect_document_code"] = _detect_document_code
ORACLES["detect_document_code"] = f"""
WITH t AS (SELECT {K}, {_CODE} AS a, 'ABC' || {num(K, 4)} AS b, 'A' || {num(K, 5)} AS c, {CODE_EXPR} AS text FROM customer)
SELECT {K}, 4 AS span_start, 4 + length(a) AS span_end, a AS value FROM t
UNION ALL
SELECT {K}, 4 + length(a) + 11, 4 + length(a) + 18, b FROM t WHERE {K} % 2 = 1
UNION ALL
SELECT {K}, length(text) - 6, length(text), c FROM t"""


# IPv6 is an opt-in detector.
IPV6_EXPR = (
    f"'at 2001:db8::' || lower(hex({K} % 65536)) || ' or ::1, not 12:' || {num(K, 2)} || ':30x and fe80::a' || cast({K} % 10 as string) || ' end'"
)


def _detect_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(K, F.expr(IPV6_EXPR).alias("text"))
    return _rows(findings(texts, Policy.only(SECRET, "ipv6"), with_value=True), K)


QUERIES["detect_ipv6"] = _detect_ipv6
ORACLES["detect_ipv6"] = f"""
WITH t AS (SELECT {K}, '2001:db8::' || lower(hex({K} % 65536)) AS a, 'fe80::a' || ({K} % 10) AS c, {IPV6_EXPR} AS text FROM customer)
SELECT {K}, 3 AS span_start, 3 + length(a) AS span_end, a AS value FROM t
UNION ALL SELECT {K}, 7 + length(a), 10 + length(a), '::1' FROM t
UNION ALL SELECT {K}, length(text) - 12, length(text) - 4, c FROM t"""


# A user's detector.
def _register_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = register_detector(
        Policy(SECRET), "customer_no", r"Customer#(\d{9})", group=1, rule=Rule(mode="redact", prefix="CUSTOMER")
    )
    texts = table(spark, sf_dir, "customer").select(K, F.concat(F.lit("<"), F.col("c_name"), F.lit(">")).alias("text"))
    spans = findings(texts.where(F.col("text").isNotNull()), policy, with_value=True)
    return _rows(spans, K)


QUERIES["register_detector"] = _register_detector
ORACLES["register_detector"] = f"""
SELECT {K}, CAST(11 AS BIGINT) - 1 AS span_start, CAST(20 AS BIGINT) - 1 AS span_end, substr(c_name, 10, 9) AS value
FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]{{9}}')"""


def _inner_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group inside its match: the number between brackets and a mark behind them."""
    policy = register_detector(
        Policy(SECRET), "customer_no", r"<Customer#(\d{9})> x", group=1, rule=Rule(mode="redact", prefix="CUSTOMER")
    )
    texts = table(spark, sf_dir, "customer").select(K, F.concat(F.lit("<"), F.col("c_name"), F.lit("> x")).alias("text"))
    return mask_with_stats(texts, policy).select(K, "text", "matches_applied")


QUERIES["register_detector_inner_group"] = _inner_group
ORACLES["register_detector_inner_group"] = f"""
SELECT {K}, '<Customer#CUSTOMER_REDACTED> x' AS text, 1 AS matches_applied FROM customer"""


def _repeated_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group whose string stands before it in the match as well: only the group is masked."""
    policy = register_detector(
        Policy(SECRET), "second_number", r"(\d+)-(\d+)x", group=2, rule=Rule(mode="redact", prefix="TAG")
    )
    number = f"cast({K} as string)"
    texts = table(spark, sf_dir, "customer").select(K, F.expr(f"{number} || '2-2x and ' || {number} || '-' || {number} || 'x'").alias("text"))
    return mask_with_stats(texts, policy).select(K, "text", "matches_applied")


QUERIES["register_detector_repeated_group"] = _repeated_group
ORACLES["register_detector_repeated_group"] = f"""
SELECT {K}, {K} || '2-TAG_REDACTEDx and ' || {K} || '-TAG_REDACTEDx' AS text, 2 AS matches_applied FROM customer"""
