"""Reports over masked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import reports
from cloakframe.plans import run
from cloakframe.plans.masking import analyze_text, findings
from cloakframe.plans.policy import Policy
from cloakframe.session import shared_folder
from queries.sqlkit import DETECTORS, SECRET, counts_text, resolved_ctes, stats_sql, table
from queries.tables import people

_POLICY = Policy.default(SECRET)
_NAMES = _POLICY.detector_names()


def _stats(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*keys, "text")
    return analyze_text(docs, _POLICY)


def _file_report_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources play the files; one more could not be read."""
    failures = table(spark, sf_dir, "region").select(
        F.concat(F.lit("bad/"), "r_name").alias("source"),
        F.lit("ValueError: malformed").alias("message"),
        (F.col("r_regionkey") == 0).alias("timed_out"),
    )
    return reports.file_report(_stats(spark, sf_dir, "source"), "source", failures)


def _file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_report_df(spark, sf_dir).withColumn("detector_counts", counts_text())


def _batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.batch_report(_file_report_df(spark, sf_dir))
    return report.withColumn("detector_totals", counts_text("detector_totals"))


def _batch_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the JSON documents of the batch and of its files."""
    documents = reports.batch_document(_file_report_df(spark, sf_dir))
    field = lambda path: F.get_json_object("document", path)
    return documents.select(
        "kind",
        field("$.source").alias("source"),
        F.coalesce(field("$.total_matches_applied"), field("$.matches_applied")).cast("bigint").alias("matches_applied"),
        F.coalesce(field("$.detector_totals.email"), field("$.detector_counts.email")).cast("bigint").alias("emails"),
    )


def _mask_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents masked and written; the totals are those observed on the way."""
    path = shared_folder(spark, "masked")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    totals = run.mask_and_report(docs, _POLICY, lambda rows: rows.write.parquet(path))
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"))
    frame = run.totals_frame(spark, totals).withColumn("detector_totals", counts_text("detector_totals"))
    return frame.join(written, F.col("texts") == F.col("written"))


def _detector_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return reports.detector_totals(findings(docs, _POLICY), by="lang")


def _column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = reports.column_profile(people(spark, sf_dir), _POLICY)
    return profile.withColumn("detector_counts", counts_text()).withColumn("hit_share", F.round("hit_share", 6))


def _page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = reports.column_profile(table(spark, sf_dir, "pages"), _POLICY, ["url", "html"])
    return profile.select("column_name", "cells", "cells_hit", counts_text())


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reports.audit_events(_file_report_df(spark, sf_dir), "source")
    return events.select(
        "event_type", "source", "matches_found", "matches_applied", "matches_skipped", F.col("metadata.overwrite").alias("overwrite")
    )


_DOCS = "SELECT doc_id AS key, text FROM documents"
_STATS = f"{resolved_ctes(_DOCS, *DETECTORS)}, stats AS ({stats_sql()})"
_FILES = f"""{_STATS},
sums AS (SELECT d.source, CAST(sum(s.matches_found) AS BIGINT) AS matches_found, CAST(sum(s.matches_applied) AS BIGINT) AS matches_applied,
                CAST(sum(s.matches_skipped) AS BIGINT) AS matches_skipped FROM stats s JOIN documents d ON d.doc_id = s.key GROUP BY d.source),
counts AS (SELECT source, string_agg(detector || ':' || n, ',' ORDER BY detector) AS detector_counts
           FROM (SELECT d.source, k.detector, count(*) AS n FROM kept k JOIN documents d ON d.doc_id = k.key GROUP BY d.source, k.detector)
           GROUP BY source),
files AS (SELECT s.source, true AS success, 'OK' AS message, s.matches_found, s.matches_applied, s.matches_skipped,
                 coalesce(c.detector_counts, '') AS detector_counts, false AS timed_out FROM sums s LEFT JOIN counts c ON c.source = s.source
          UNION ALL SELECT 'bad/' || r_name, false, 'ValueError: malformed', 0, 0, 0, '', r_regionkey = 0 FROM region)"""

QUERIES = {
    "mask_and_report": _mask_and_report,
    "file_report": _file_report,
    "batch_report": _batch_report,
    "batch_document": _batch_document,
    "detector_totals": _detector_totals,
    "column_profile": _column_profile,
    "page_profile": _page_profile,
    "audit_events": _audit,
}
ORACLES = {
    "file_report": f"WITH {_FILES} SELECT * FROM files",
    "batch_report": f"""
WITH {_FILES}
SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
  CAST(sum(matches_found) AS BIGINT) AS total_matches_found, CAST(sum(matches_applied) AS BIGINT) AS total_matches_applied,
  CAST(sum(matches_skipped) AS BIGINT) AS total_matches_skipped, count(*) FILTER (timed_out) AS timeout_count,
  (SELECT string_agg(detector || ':' || n, ',' ORDER BY detector) FROM (SELECT detector, count(*) AS n FROM kept GROUP BY detector)) AS detector_totals
FROM files""",
    "batch_document": f"""
WITH {_FILES}, emails AS (SELECT d.source, count(*) AS n FROM kept k JOIN documents d ON d.doc_id = k.key WHERE detector = 'email' GROUP BY d.source)
SELECT 'file' AS kind, f.source, f.matches_applied, e.n AS emails FROM files f LEFT JOIN emails e ON e.source = f.source
UNION ALL SELECT 'statistics', NULL, CAST((SELECT sum(matches_applied) FROM files) AS BIGINT), CAST((SELECT sum(n) FROM emails) AS BIGINT)""",
    "mask_and_report": f"""
WITH {resolved_ctes(_DOCS, *DETECTORS)}, stats AS ({stats_sql()}), n AS (SELECT count(*) AS n FROM documents)
SELECT (SELECT n FROM n) AS texts, (SELECT n FROM n) AS written, CAST(sum(matches_found) AS BIGINT) AS matches_found,
  CAST(sum(matches_applied) AS BIGINT) AS matches_applied, CAST(sum(matches_skipped) AS BIGINT) AS matches_skipped,
  (SELECT string_agg(detector || ':' || n, ',' ORDER BY detector) FROM (SELECT detector, count(*) AS n FROM kept GROUP BY detector)) AS detector_totals
FROM stats""",
    "detector_totals": f"""
WITH {resolved_ctes(_DOCS, *DETECTORS)}
SELECT d.lang, k.detector, count(*) AS n FROM kept k JOIN documents d ON d.doc_id = k.key
GROUP BY GROUPING SETS ((d.lang, k.detector), (k.detector))""",
    "column_profile": """
SELECT p.column_name, count(*) FILTER (p.column_name <> 'token' OR c_custkey % 5 <> 0) AS cells,
  CASE WHEN p.hits = '' THEN 0 ELSE count(*) END AS cells_hit, CASE WHEN p.hits = '' THEN 0.0 ELSE 1.0 END AS hit_share,
  replace(p.hits, '#', CAST(count(*) AS VARCHAR)) AS detector_counts
FROM customer, (VALUES ('contact', 'email:#'), ('comment', 'email:#,ip_address:#'), ('Password', 'email:#'), ('token', ''),
  ('empty_token', 'email:#'), ('formula', 'ip_address:#')) p(column_name, hits)
GROUP BY p.column_name, p.hits""",
    "page_profile": f"""
WITH {resolved_ctes("SELECT 'html' || page_id AS key, html AS text FROM pages UNION ALL SELECT 'url' || page_id, url FROM pages", *DETECTORS)},
per AS (SELECT regexp_extract(t.key, '^[a-z]+') AS column_name, length(t.text) AS n, k.detector, t.key
        FROM texts t LEFT JOIN kept k ON k.key = t.key)
SELECT column_name, count(DISTINCT key) FILTER (n > 0) AS cells, count(DISTINCT key) FILTER (detector IS NOT NULL) AS cells_hit,
  coalesce((SELECT string_agg(detector || ':' || c, ',' ORDER BY detector) FROM
     (SELECT detector, count(*) AS c FROM per q WHERE q.column_name = p.column_name AND detector IS NOT NULL GROUP BY detector)), '') AS detector_counts
FROM per p GROUP BY column_name""",
    "audit_events": f"""
WITH {_FILES}
SELECT 'file_processing_started' AS event_type, source, 0 AS matches_found, 0 AS matches_applied, 0 AS matches_skipped, 'false' AS overwrite FROM files
UNION ALL SELECT 'file_processing_finished', source, matches_found, matches_applied, matches_skipped, NULL FROM files WHERE success""",
}
