"""Named-entity candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import ner
from cloakframe.plans.masking import findings, mask_with_stats
from cloakframe.plans.policy import Policy
from queries.sqlkit import K, SECRET, table, token_sql

# Candidates derived from the line items: an order is a text, its items are candidates of four
# providers, many of them overlapping, some without confidence, some malformed.
_COLUMNS = {
    "doc_id": "l_orderkey",
    "entity_type": "CASE l_partkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' WHEN 3 THEN 'address' ELSE CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'person' END END",
    "start": "CAST(l_partkey % 60 * 7 - CASE WHEN l_suppkey % 17 = 0 THEN 500 ELSE 0 END AS INT)",
    "end": "CAST(l_partkey % 60 * 7 - CASE WHEN l_suppkey % 17 = 0 THEN 500 ELSE 0 END + 3 + l_suppkey % 40 AS INT)",
    "value": "'v' || cast(l_partkey % 60 * 7 as string) || '-' || cast(l_suppkey % 40 as string)",
    "source": "CASE l_linenumber % 4 WHEN 0 THEN 'spacy' WHEN 1 THEN 'natasha' WHEN 2 THEN 'qwen' ELSE 'gliner' END",
    "confidence": "CASE WHEN l_tax < 0.02 THEN NULL ELSE round(l_discount * 10 + CASE WHEN l_suppkey % 23 = 0 THEN 1 ELSE 0 END, 4) END",
    "priority": "CASE l_linenumber % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 15 ELSE 10 END",
}
_CAND_SQL = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in _COLUMNS.items()) + ", l_linenumber FROM lineitem"
_VALID = """length(entity_type) > 0 AND length(source) > 0 AND "start" >= 0 AND "end" > "start" AND (confidence IS NULL OR confidence BETWEEN 0 AND 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in _COLUMNS.items()])


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.ner_validate(_candidates(spark, sf_dir))


_WIDE = ", ".join(f'"{c}"' for c in _COLUMNS)


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir)
    return ner.ner_union(*[rows.where(F.col("source") == s) for s in ("gliner", "spacy", "natasha", "qwen")])


_SEQ = "CASE source WHEN 'gliner' THEN 0 WHEN 'spacy' THEN 1 WHEN 'natasha' THEN 2 ELSE 3 END"
_UNION_SQL = f"SELECT {_WIDE}, {_SEQ} AS seq FROM ({_CAND_SQL}) WHERE {_VALID}"


def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.ner_cluster(_union(spark, sf_dir)).select("doc_id", "start", "end", "source", "entity_type", "cluster")


_CLUSTER_SQL = """
c0 AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cand),
c1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS n FROM c0),
clustered AS (SELECT *, min("start") OVER (PARTITION BY doc_id, n) AS cluster FROM c1)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.ner_resolve(_union(spark, sf_dir), min_confidence=0.3)


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


_RESOLVE_SQL = f"""
WITH cand AS (SELECT * FROM ({_UNION_SQL}) WHERE confidence IS NULL OR confidence >= 0.3),
{_CLUSTER_SQL},
seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY "start", "end", seq) AS place FROM clustered),
typed AS (SELECT *, min(place) OVER (PARTITION BY doc_id, cluster, entity_type) AS first_place,
            max(confidence) OVER (PARTITION BY doc_id, cluster, entity_type) AS best_confidence FROM seen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster
            ORDER BY -priority, -coalesce(confidence, 0), "start" - "end", "start", first_place, place) AS r FROM typed),
sources AS (SELECT doc_id, cluster, entity_type, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM clustered GROUP BY ALL)
SELECT r.doc_id, r.entity_type, r."start", r."end", r.value, s.sources, r.best_confidence AS confidence
FROM ranked r JOIN sources s ON s.doc_id = r.doc_id AND s.cluster = r.cluster AND s.entity_type = r.entity_type WHERE r.r = 1"""

# Texts of customers with the name of their nation; a gazetteer provider finds names and nations.
_TEXT = f"'Client ' || c_name || ' of NATION_' || cast(c_nationkey as string) || ' x' || c_name || ', tel 8916' || lpad(cast({K} as string), 7, '0')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col(K).alias("doc_id"), F.expr(_TEXT).alias("text"))


def _make_provider():
    import re

    names, nations = re.compile(r"Customer#\d{9}"), re.compile(r"NATION_\d+")

    def provider(texts):
        for text in texts:
            found = [("full-name", *hit.span(), 0.9) for hit in names.finditer(text)]
            yield found + [("GPE", *hit.span(), None) for hit in nations.finditer(text)]

    return provider


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.ner_annotate(_texts(spark, sf_dir), _make_provider, source="spacy", priority=30)


def _safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _annotated(spark, sf_dir).join(_texts(spark, sf_dir), "doc_id")
    safe = ner.ner_safe_span(F.col("text"), F.col("start"), F.col("end"), F.col("value"))
    return joined.select("doc_id", "start", "end", safe.alias("safe"))


def _ner_policy() -> Policy:
    return Policy.only(SECRET, "phone", ner=True)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = ner.ner_resolve(_annotated(spark, sf_dir), min_confidence=0.5)
    return ner.ner_spans(_texts(spark, sf_dir), resolved)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_entities(spark, sf_dir), _ner_policy(), keys=["doc_id"], extra="entities", with_value=True)
    return found.select("doc_id", "detector", F.col("start").cast("bigint").alias("span_start"), "value", "applied")


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_with_stats(_entities(spark, sf_dir), _ner_policy(), extra="entities")
    return masked.select("doc_id", F.col("text").alias("masked"), "matches_applied")


# Model answers as text, with chatter, bad items and brackets around the list.
_ANSWER = (
    f"'Sure [note]: [' || chr(10) || '{{\"label\":\"PER\",\"start\":7,\"end\":25,\"confidence\":0.' || cast({K} % 10 as string) || '}},"
    f"{{\"label\":5,\"start\":1,\"end\":2,\"confidence\":1}},\"x\",{{\"label\":\"Custom One\",\"start\":' || cast({K} % 30 as string) || '"
    f",\"end\":' || cast({K} % 90 as string) || ',\"confidence\":1}},{{\"label\":\"ORG\",\"start\":1.5,\"end\":3,\"confidence\":0.9}}] done]'"
)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).withColumn("answer", F.expr(_ANSWER.replace(K, "doc_id")))
    return ner.ner_parse_json(rows).withColumn("confidence", F.round("confidence", 6))


QUERIES = {
    "ner_validate": _valid,
    "ner_rejected": lambda spark, sf_dir: ner.ner_rejected(_candidates(spark, sf_dir)),
    "ner_filter_confidence": lambda spark, sf_dir: ner.ner_filter_confidence(_valid(spark, sf_dir), 0.3),
    "ner_union": _union,
    "ner_cluster": _cluster,
    "ner_resolve": _resolve,
    "ner_annotate": _annotated,
    "ner_safe_span": _safe,
    "ner_spans": _spans,
    "ner_mask": _mask,
    "ner_parse_json": _parsed,
}
_HITS = f"""
h AS (SELECT {K} AS doc_id, {_TEXT} AS text, c_name, 'NATION_' || c_nationkey AS nation FROM customer),
a AS (SELECT doc_id, 'person' AS entity_type, 7 AS s, c_name AS value, CAST(0.9 AS DOUBLE) AS confidence, true AS safe FROM h
      UNION ALL SELECT doc_id, 'location', 11 + length(c_name), nation, NULL, true FROM h
      UNION ALL SELECT doc_id, 'person', 13 + length(c_name) + length(nation), c_name, 0.9, false FROM h)"""
_PHONE = f"'8916' || lpad(cast({K} as string), 7, '0')"
ORACLES = {
    "ner_validate": f"SELECT {_WIDE} FROM ({_CAND_SQL}) WHERE {_VALID}",
    "ner_rejected": f"SELECT {_WIDE} FROM ({_CAND_SQL}) WHERE NOT ({_VALID})",
    "ner_filter_confidence": f"SELECT {_WIDE} FROM ({_CAND_SQL}) WHERE {_VALID} AND (confidence IS NULL OR confidence >= 0.3)",
    "ner_union": _UNION_SQL,
    "ner_cluster": f"""
WITH cand AS ({_UNION_SQL}), {_CLUSTER_SQL} SELECT doc_id, "start", "end", source, entity_type, cluster FROM clustered""",
    "ner_resolve": _RESOLVE_SQL,
    "ner_annotate": f"""
WITH {_HITS} SELECT doc_id, entity_type, s AS "start", s + length(value) AS "end", value, 'spacy' AS source, confidence, 30 AS priority FROM a""",
    "ner_safe_span": f"""WITH {_HITS} SELECT doc_id, s AS "start", s + length(value) AS "end", safe FROM a""",
    "ner_spans": f"""
WITH {_HITS}
SELECT doc_id, entity_type AS detector, s AS span_start, value, true AS applied FROM a WHERE safe
UNION ALL SELECT doc_id, 'phone', length(text) - 11, right(text, 11), true FROM h""",
    "ner_mask": f"""
SELECT {K} AS doc_id, 'Client ' || {token_sql('c_name', 'PERSON')} || ' of ' || {token_sql("'NATION_' || c_nationkey", 'LOC')}
  || ' x' || c_name || ', tel ' || {token_sql(_PHONE, 'PHONE')} AS masked, 3 AS matches_applied FROM customer""",
    "ner_parse_json": f"""
WITH t AS (SELECT {K} AS doc_id, {_TEXT} AS text FROM customer),
i AS (SELECT doc_id, 'person' AS entity_type, 7 AS s, 25 AS e, (doc_id % 10) / 10.0 AS confidence, text FROM t
      UNION ALL SELECT doc_id, 'custom_one', doc_id % 30, doc_id % 90, 1.0, text FROM t)
SELECT doc_id, entity_type, s AS "start", e AS "end", substr(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS value, 'qwen' AS source,
  CAST(confidence AS DOUBLE) AS confidence, 15 AS priority
FROM i WHERE confidence >= 0.5 AND e > s AND e <= length(text)""",
}
