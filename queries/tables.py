"""Field rules over flat and nested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.fields import (
    field_remove,
    mask_nested,
    mask_table,
    nested_findings,
    nested_stats,
    redact_sensitive_columns,
)
from cloakframe.plans.policy import FieldRule, Policy
from cloakframe.sources.formats import mask_json
from queries.sqlkit import K, SECRET, counts_text, table, token_sql

MAIL = f"'u' || cast({K} as string) || '@mail.ru'"
HOST = f"'10.0.0.' || cast({K} % 256 as string)"
_MAIL_TOKEN = token_sql(MAIL, "EMAIL")
_HOST_TOKEN = token_sql(HOST, "IP")
_RULES = {
    "PASSWORD": FieldRule(action="remove"),
    "Token": FieldRule(action="replace", replacement="[hidden]"),
    "empty_token": FieldRule(action="replace"),
    "comment": FieldRule(action="mask"),
    "contact": FieldRule(enabled=False, action="remove"),
}
POLICY = Policy.default(SECRET, field_rules=_RULES)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contact table derived from the customers."""
    return table(spark, sf_dir, "customer").select(
        K,
        F.expr(MAIL).alias("contact"),
        F.expr(f"'call ' || {MAIL} || ' from ' || {HOST}").alias("comment"),
        F.expr(f"'pw' || cast({K} as string) || '@secret.ru'").alias("Password"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'tok' || cast(c_custkey as string) END").alias("token"),
        F.lit("x@y.ru").alias("empty_token"),
        F.expr(f"CASE WHEN {K} % 2 = 0 THEN '=' ELSE '' END || 'A1 & ' || {HOST}").alias("formula"),
        "c_acctbal",
    )


_SQL_COMMON = f"""{_MAIL_TOKEN} AS contact, 'call ' || {_MAIL_TOKEN} || ' from ' || {_HOST_TOKEN} AS comment,
  CASE WHEN {K} % 5 = 0 THEN NULL ELSE '[hidden]' END AS token, '' AS empty_token"""
_FORMULA = f"CASE WHEN {K} % 2 = 0 THEN '=A1 & ' || {HOST} ELSE 'A1 & ' || {_HOST_TOKEN} END"


def _mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_table(people(spark, sf_dir), POLICY, with_stats=True)
    return masked.withColumn("detector_counts", counts_text())


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_table(people(spark, sf_dir), POLICY, skip_formulas=True).select(K, "formula", "contact")


def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_table(people(spark, sf_dir).select(K, "token", "empty_token"), POLICY)


def _remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_remove(people(spark, sf_dir).select(K, "Password", "token"), POLICY)


def _blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_remove(people(spark, sf_dir).select(K, "Password", "token"), POLICY, blank=True)


def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        K, F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("ACCOUNT")
    )
    return redact_sensitive_columns(rows)


def orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents derived from the orders: structs, arrays, maps, numbers, nulls."""
    mail = "'u' || cast(o_custkey as string) || '@mail.ru'"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(
            F.expr(mail).alias("email"),
            F.expr("'pw' || cast(o_orderkey as string)").alias("password"),
            F.col("o_totalprice").alias("score"),
            F.struct(F.expr(f"'to ' || {mail}").alias("comment"), F.lit(1).alias("password")).alias("inner"),
        ).alias("user"),
        F.expr(f"array({mail}, 'none', cast(null as string))").alias("emails"),
        F.expr("array('t1', 't2')").alias("token"),
        F.expr(f"map('Token', 'abc', 'mail', {mail}, 'PASSWORD', 'zzz')").alias("tags"),
        F.expr("array(named_struct('password', 'p', 'ip', '10.0.0.1'), named_struct('password', 'q', 'ip', 'no'))").alias(
            "hosts"
        ),
    )


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_nested(orders_nested(spark, sf_dir), POLICY, keep=["o_orderkey"])
    return masked.select("o_orderkey", *[F.to_json(c).alias(f"{c}_json") for c in masked.columns if c != "o_orderkey"])


def _nested_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = nested_stats(orders_nested(spark, sf_dir), POLICY, ["o_orderkey"])
    return stats.withColumn("detector_counts", counts_text())


def _nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nested_findings(orders_nested(spark, sf_dir), POLICY, ["o_orderkey"])
    return found.groupBy("field", "detector", "applied").agg(F.count(F.lit(1)).alias("n"))


def _json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON column of the events, and one derived from them that holds sensitive values."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "props",
        F.expr(
            """concat('{"user":{"email":"u', cast(user_id as string), '@mail.ru","id":', cast(user_id as string),"""
            """ ',"ok":true,"gone":null,"password":"x"},"emails":["a', cast(user_id as string), '@b.ru","-"]}')"""
        ).alias("doc"),
    )
    masked = mask_json(events, POLICY, "props", "struct<k:bigint>")
    kind = "struct<user:struct<email:string,id:bigint,ok:boolean,gone:string,password:string>,emails:array<string>>"
    return mask_json(masked, POLICY, "doc", kind)


_ORDER_MAIL = "'u' || o_custkey || '@mail.ru'"
_ORDER_TOKEN = token_sql(_ORDER_MAIL, "EMAIL")
_EVENT_A = token_sql("'u' || user_id || '@mail.ru'", "EMAIL")
_EVENT_B = token_sql("'a' || user_id || '@b.ru'", "EMAIL")

QUERIES = {
    "mask_table": _mask_table,
    "skip_formula_cells": _formulas,
    "field_replace": _replace,
    "field_remove": _remove,
    "field_remove_blank": _blank,
    "redact_sensitive_columns": _redact,
    "mask_nested": _nested,
    "nested_stats": _nested_stats,
    "nested_findings": _nested_findings,
    "mask_json": _json_column,
}
ORACLES = {
    "mask_table": f"""
SELECT {K}, {_SQL_COMMON}, '' AS "Password", CASE WHEN {K} % 2 = 0 THEN '=' ELSE '' END || 'A1 & ' || {_HOST_TOKEN} AS formula,
  c_acctbal, CAST(4 AS BIGINT) AS matches_found, CAST(4 AS BIGINT) AS matches_applied, CAST(0 AS BIGINT) AS matches_skipped,
  'email:2,ip_address:2' AS detector_counts FROM customer""",
    "skip_formula_cells": f"SELECT {K}, {_FORMULA} AS formula, {_MAIL_TOKEN} AS contact FROM customer",
    "field_replace": f"SELECT {K}, CASE WHEN {K} % 5 = 0 THEN NULL ELSE '[hidden]' END AS token, '' AS empty_token FROM customer",
    "field_remove": f"SELECT {K}, CASE WHEN {K} % 5 = 0 THEN NULL ELSE 'tok' || {K} END AS token FROM customer",
    "field_remove_blank": f"""
SELECT {K}, '' AS "Password", CASE WHEN {K} % 5 = 0 THEN NULL ELSE 'tok' || {K} END AS token FROM customer""",
    "redact_sensitive_columns": f"""
SELECT {K}, '[REDACTED]' AS "Name", c_mktsegment AS segment, '[REDACTED]' AS "ACCOUNT" FROM customer""",
    "mask_nested": f"""
WITH t AS (SELECT *, {_ORDER_TOKEN} AS mail, {token_sql("'10.0.0.1'", 'IP')} AS host FROM orders)
SELECT o_orderkey,
  '{{"email":"' || mail || '","score":' || CAST(o_totalprice AS VARCHAR) || ',"inner":{{"comment":"to ' || mail || '","password":1}}}}' AS user_json,
  '["' || mail || '","none",null]' AS emails_json, '["[hidden]","[hidden]"]' AS token_json,
  '{{"Token":"[hidden]","mail":"' || mail || '"}}' AS tags_json,
  '[{{"ip":"' || host || '"}},{{"ip":"no"}}]' AS hosts_json
FROM t""",
    "nested_stats": """
SELECT o_orderkey, CAST(5 AS BIGINT) AS matches_found, CAST(5 AS BIGINT) AS matches_applied, CAST(0 AS BIGINT) AS matches_skipped,
  'email:4,ip_address:1' AS detector_counts FROM orders""",
    "nested_findings": """
SELECT f.field, f.detector, true AS applied, count(*) AS n FROM orders,
  (VALUES ('email', 'email'), ('comment', 'email'), ('emails', 'email'), ('mail', 'email'), ('ip', 'ip_address')) f(field, detector)
GROUP BY f.field, f.detector""",
    "mask_json": f"""
SELECT event_id, '{{"k":' || regexp_extract(props, '[0-9]+') || '}}' AS props,
  '{{"user":{{"email":"' || {_EVENT_A} || '","id":' || user_id || ',"ok":true,"gone":null}},"emails":["' || {_EVENT_B} || '","-"]}}' AS doc
FROM events""",
}
