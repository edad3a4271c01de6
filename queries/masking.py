"""Scalar functions: the four maskers, checksums, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import checksums
from cloakframe.functions.labels import (
    file_stem,
    file_suffix,
    is_supported_file,
    local_name,
    normalize_entity_type,
    output_label,
    safe_file_name,
)
from cloakframe.functions.maskers import mask_hmac, mask_partial, mask_preserve_format, mask_redact
from cloakframe.plans.extend import register_masker
from cloakframe.plans.masking import mask_with_stats
from cloakframe.plans.policy import Policy
from queries.sqlkit import (
    INN_10,
    INN_12_A,
    INN_12_B,
    K,
    PHONE_EXPR,
    SECRET,
    SNILS,
    digit,
    hmac_sql,
    inn_text,
    num,
    ogrn_text,
    snils_text,
    table,
    weighted,
)

QUERIES = {}
ORACLES = {}

# Values of many shapes per customer: names, addresses, short and empty strings, Cyrillic.
_VALUES = {
    "name": "c_name",
    "mail": f"'u' || cast({K} as string) || '@mail' || cast({K} % 10 as string) || '.ru'",
    "tiny": f"substr('ab@cde', 1, cast({K} % 7 as int))",
    "cyr": f"'Иванов Пётр ' || cast({K} as string) || ', ёЁ-яЯ'",
    "long": f"repeat('Ab9 Жы+', cast({K} % 13 as int))",
}
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT {K}, '{kind}' AS kind, {expr} AS value FROM customer" for kind, expr in _VALUES.items()
)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("value")) for k, e in _VALUES.items()])
    return table(spark, sf_dir, "customer").select(K, F.explode(rows).alias("r")).select(K, "r.kind", "r.value")


def _scalar(name, column, sql):
    QUERIES[name] = lambda spark, sf_dir: _values(spark, sf_dir).select(K, "kind", column(F.col("value")).alias("masked"))
    ORACLES[name] = f"SELECT {K}, kind, {sql} AS masked FROM ({_VALUES_SQL})"


_scalar(
    "mask_hmac",
    lambda v: F.concat_ws(" ", mask_hmac(v, SECRET, "NAME"), mask_hmac(v, "k" * 100, "LONG", 64)),
    f"'NAME_' || substr({hmac_sql('value')}, 1, 24) || ' LONG_' || {hmac_sql('value', 'k' * 100)}",
)


def _partial_sql(visible: int) -> str:
    at = "CAST(strpos(value, '@') AS INTEGER)"
    return (
        f"CASE WHEN value = '' THEN '' WHEN {at} > 1 THEN "
        f"CASE WHEN {at} - 1 > {visible} THEN substr(value, 1, {visible}) ELSE '' END || '***' || substr(value, {at}) "
        f"WHEN length(value) <= {2 * visible} THEN '***' "
        f"ELSE substr(value, 1, {visible}) || '***' || right(value, {visible}) END"
    )


_scalar("mask_partial", mask_partial, _partial_sql(2))
_scalar("mask_partial_three", lambda v: mask_partial(v, 3), _partial_sql(3))
_scalar(
    "mask_redact",
    lambda v: F.concat(mask_redact("NAME"), mask_redact()),
    "'NAME_REDACTED[REDACTED]'",
)

# Byte i of the stream of keyed digests of "0:value", "1:value", ... picks character i.
_HEX = "strpos('0123456789abcdef', substr(stream, CAST({} AS INTEGER), 1)) - 1"
_BYTE = f"(({_HEX.format('2 * i - 1')}) * 16 + {_HEX.format('2 * i')})"


def _pick(alphabet: str) -> str:
    return f"substr('{alphabet}', CAST({_BYTE} % {len(alphabet)} AS INTEGER) + 1, 1)"


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR_LOW, _CYR_UP = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
QUERIES["mask_preserve_format"] = lambda spark, sf_dir: _values(spark, sf_dir).select(
    K, "kind", mask_preserve_format(F.col("value"), SECRET).alias("masked")
)
ORACLES["mask_preserve_format"] = f"""
WITH v AS ({_VALUES_SQL}),
s AS (SELECT *, {hmac_sql("'0:' || value")} || {hmac_sql("'1:' || value")} || {hmac_sql("'2:' || value")} AS stream FROM v),
c AS (SELECT {K}, kind, stream, substr(value, CAST(i AS INTEGER), 1) AS c, i
      FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM s)),
m AS (SELECT {K}, kind, i, CASE WHEN c BETWEEN '0' AND '9' THEN {_pick('0123456789')}
        WHEN c BETWEEN 'a' AND 'z' THEN {_pick(_LOW)} WHEN c BETWEEN 'A' AND 'Z' THEN {_pick(_UP)}
        WHEN c BETWEEN 'а' AND 'я' THEN {_pick(_CYR_LOW)} WHEN c BETWEEN 'А' AND 'Я' THEN {_pick(_CYR_UP)} ELSE c END AS o FROM c)
SELECT v.{K}, v.kind, coalesce(x.masked, '') AS masked
FROM v LEFT JOIN (SELECT {K}, kind, string_agg(o, '' ORDER BY i) AS masked FROM m GROUP BY {K}, kind) x
  ON x.{K} = v.{K} AND x.kind = v.kind"""

# -- checksums -----------------------------------------------------------------------------------

_N12 = num(f"{K} * 104729 + 500100732259", 12)
_INN_10_OK = f"{weighted('v', INN_10)} % 11 % 10 = {digit('v', 10)}"
_INN_12_OK = f"({weighted('v', INN_12_A)} % 11 % 10 = {digit('v', 11)} AND {weighted('v', INN_12_B)} % 11 % 10 = {digit('v', 12)})"


def _checked(name, column, expr, sql):
    QUERIES[name] = lambda spark, sf_dir: (
        table(spark, sf_dir, "customer")
        .select(K, F.expr(expr).alias("value"))
        .select(K, "value", column(F.col("value")).alias("valid"))
    )
    ORACLES[name] = f"SELECT {K}, v AS value, {sql} AS valid FROM (SELECT {K}, {expr} AS v FROM customer)"


_checked("is_valid_inn", checksums.is_valid_inn, inn_text(K), _INN_10_OK)
_checked("is_valid_inn_person", checksums.is_valid_inn, _N12, _INN_12_OK)
_checked(
    "is_valid_ogrn",
    checksums.is_valid_ogrn,
    ogrn_text(K),
    f"CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = {digit('v', 13)}",
)
_checked(
    "is_valid_snils",
    checksums.is_valid_snils,
    snils_text(K),
    f"substr(v, 1, 2) <> '00' AND {weighted(chr(40) + 'replace(v, ' + repr('-') + ', ' + repr('') + ')' + chr(41), SNILS)} % 101 % 100 = CAST(right(v, 2) AS INT)",
)
_checked(
    "is_valid_ipv4",
    checksums.is_valid_ipv4,
    f"cast({K} % 300 as string) || '.' || cast({K} % 17 as string) || '.0.' || cast({K} % 260 as string)",
    f"{K} % 300 < 256 AND {K} % 260 < 256",
)
_checked("digits_only", checksums.digits_only, snils_text(K), "replace(replace(v, '-', ''), ' ', '')")

# -- names ---------------------------------------------------------------------------------------

_LABEL = (
    f"CASE {K} % 8 WHEN 0 THEN ' full-name ' WHEN 1 THEN 'Legal Entity' WHEN 2 THEN 'GPE' WHEN 3 THEN 'bank_account'"
    f" WHEN 4 THEN 'Custom Label' WHEN 5 THEN 'per' WHEN 6 THEN 'DOCUMENT' ELSE c_mktsegment END"
)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(K, F.expr(_LABEL).alias("label"))
    return rows.select(K, normalize_entity_type(F.col("label")).alias("entity_type"))


QUERIES["normalize_entity_type"] = _labels
ORACLES["normalize_entity_type"] = f"""
SELECT {K}, CASE {K} % 8 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' WHEN 3 THEN 'bank_account'
  WHEN 4 THEN 'custom_label' WHEN 5 THEN 'person' WHEN 6 THEN 'document' ELSE lower(c_mktsegment) END AS entity_type
FROM customer"""

_PATH = f"'/in/part ' || cast({K} as string) || '/Отчёт за ' || cast({K} as string) || '.v2' || CASE {K} % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '' END"


def _file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "customer").select(K, F.expr(_PATH).alias("path")).select(
        K,
        output_label(p).alias("masked_name"),
        output_label(p, "demasked").alias("demasked_name"),
        file_suffix(p).alias("suffix"),
        file_stem(p).alias("stem"),
        safe_file_name(p).alias("safe_name"),
        is_supported_file(p).alias("supported"),
        local_name(F.concat(F.lit("{urn:x}"), file_suffix(p))).alias("bare_name"),
    )


QUERIES["output_label"] = _file_names
ORACLES["output_label"] = f"""
WITH t AS (SELECT {K}, CASE {K} % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.v2' END AS suffix,
                  CASE {K} % 4 WHEN 3 THEN '' ELSE '.v2' END AS tail,
                  CASE {K} % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.v2' END AS raw FROM customer)
SELECT {K}, '_' || {K} || tail || '.masked' || suffix AS masked_name, '_' || {K} || tail || '.demasked' || suffix AS demasked_name,
       suffix, 'Отчёт за ' || {K} || tail AS stem, '_' || {K} || tail || raw AS safe_name, suffix IN ('.csv', '.txt') AS supported,
       suffix AS bare_name
FROM t"""


# -- a user's masker -------------------------------------------------------------------------------


def _own_masker(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = register_masker(
        Policy.only(SECRET, "phone"), "phone", lambda v: F.concat(F.lit("<tel "), F.length(v).cast("string"), F.lit(">"))
    )
    texts = table(spark, sf_dir, "customer").select(K, F.expr(PHONE_EXPR).alias("text"))
    return mask_with_stats(texts, policy).select(K, F.col("text").alias("masked"), "matches_applied")


QUERIES["register_masker"] = _own_masker
ORACLES["register_masker"] = f"""
SELECT {K}, 'tel <tel 18> or <tel 11> not 8---' || {num(K, 3)} || '-123-45-67 nor 58' || {num(K + ' + 9160000000', 10)}
  || ' but <tel 13>, <tel 15>' AS masked, 4 AS matches_applied FROM customer"""
