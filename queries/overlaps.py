"""Key positions, overlap resolution, and reports on what was skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.patterns import BUILTIN_DETECTORS
from cloakframe.functions.spans import detect_spans, drop_key_positions
from cloakframe.operators import conflicts
from cloakframe.plans.masking import explode_spans, findings
from cloakframe.plans.policy import Policy
from queries.sqlkit import ALL_TEXTS_SQL, DETECTORS, K, SECRET, all_texts, num, resolved_ctes, table

_CTES = resolved_ctes(ALL_TEXTS_SQL, *DETECTORS)
_ROW = "key, detector, s AS span_start, e AS span_end"


def _spans(df: DataFrame) -> DataFrame:
    return df.select(
        "key",
        "detector",
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(all_texts(spark, sf_dir), Policy.default(SECRET))
    return found.select(
        "key",
        "detector",
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        F.col("length").cast("bigint").alias("span_length"),
        "applied",
    )


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(findings(all_texts(spark, sf_dir), Policy.default(SECRET)).where("applied"))


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(conflicts.skipped_findings(all_texts(spark, sf_dir), Policy.default(SECRET), ["key"]))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conflicts.overlap_conflicts(all_texts(spark, sf_dir), Policy.default(SECRET), ["key"])
    return pairs.select(
        "key",
        "lost_detector",
        F.col("lost_start").cast("bigint").alias("lost_start"),
        "kept_detector",
        F.col("kept_start").cast("bigint").alias("kept_start"),
    )


_KEYED = f"'0' || {num(K, 8)} || repeat(' ', cast({K} % 6 as int)) || '=' || ' 0' || {num(K + ' + 1', 8)} || ' =='"


def _key_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(K, F.expr(_KEYED).alias("text"))
    spans = detect_spans(F.col("text"), BUILTIN_DETECTORS["bik"])
    kept = F.transform(
        drop_key_positions(F.col("text"), F.col("_all")),
        lambda s: F.struct(
            s["detector"].alias("detector"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.lit(True).alias("applied"),
        ),
    )
    staged = texts.withColumn("_all", spans).withColumn("_kept", kept)
    return explode_spans(staged, "_kept", [K], with_value=True).select(
        K, F.col("start").cast("bigint").alias("span_start"), "value"
    )


QUERIES = {
    "findings": _findings,
    "resolve_overlaps": _resolve,
    "skipped_findings": _skipped,
    "overlap_conflicts": _conflicts,
    "drop_key_positions": _key_positions,
}
ORACLES = {
    "findings": f"""
WITH {_CTES}
SELECT f.key, f.detector, f.s AS span_start, f.e AS span_end, f.e - f.s AS span_length, k.key IS NOT NULL AS applied
FROM found f LEFT JOIN kept k ON k.key = f.key AND k.detector = f.detector AND k.s = f.s""",
    "resolve_overlaps": f"WITH {_CTES} SELECT {_ROW} FROM kept",
    "skipped_findings": f"""
WITH {_CTES} SELECT {_ROW} FROM found f
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.key = f.key AND k.detector = f.detector AND k.s = f.s)""",
    "overlap_conflicts": f"""
WITH {_CTES}
SELECT f.key, f.detector AS lost_detector, f.s AS lost_start, k.detector AS kept_detector, k.s AS kept_start
FROM found f JOIN kept k ON k.key = f.key AND k.s < f.e AND f.s < k.e
WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.key = f.key AND q.detector = f.detector AND q.s = f.s)""",
    "drop_key_positions": f"""
SELECT {K}, 0 AS span_start, '0' || {num(K, 8)} AS value FROM customer WHERE {K} % 6 > 3""",
}
