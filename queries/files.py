"""Files: formats written from the tables, read back, masked; encodings; streams.

Files go to a new folder below the shared one of the session (see ``shared_folder``).
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import mapping as m
from cloakframe.operators import reports
from cloakframe.operators.fields import mask_nested
from cloakframe.plans.policy import FieldRule, Policy
from cloakframe.session import shared_folder
from cloakframe.sources import blocks as blocks_of
from cloakframe.sources import formats, readers, sinks
from cloakframe.streaming import streams
from queries.sqlkit import (
    DETECTORS,
    PASSPHRASE,
    SECRET,
    K,
    counts_text,
    num,
    resolved_ctes,
    stats_sql,
    table,
    token_sql,
)
from queries.tables import POLICY, people

_PLAIN = Policy.default(SECRET)

# -- line formats --------------------------------------------------------------------------------

_MAIL = "'u' || cast(user_id as string) || '@mail.ru'"
_HOST = "'10.0.' || cast(user_id % 256 as string) || '.1'"
_STAMP = "'2024-01-' || lpad(cast(1 + event_id % 28 as string), 2, '0')"
_LINES = {
    0: f"{_STAMP} || ' 10:23:45,123 INFO auth - login ' || {_MAIL}",
    1: f"{_STAMP} || 'T10:23:45.123Z [ERROR] ' || {_MAIL} || ': failed from ' || {_HOST}",
    2: f"'[' || lpad(cast(1 + event_id % 28 as string), 2, '0') || '/Jan/2024:10:23:45 +0000] ' || {_HOST} || ' GET /'",
    3: f"'{{10:23:45.123-0,PROC,' || cast(event_id as string) || '}}' || {_MAIL}",
    4: f"'    at com.example.Service(' || {_MAIL} || ')'",
    5: f"'Caused by: ' || {_MAIL}",
    6: f"'plain line with ' || {_MAIL} || ' and ' || {_HOST}",
    7: "'{10:23:45.123-0,PROC,' || cast(event_id as string) || '}'",
}
_LINE_EXPR = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {e}" for k, e in _LINES.items()) + " END"
_M, _H = token_sql(_MAIL, "EMAIL"), token_sql(_HOST, "IP")
_MASKED = {
    0: _LINES[0].replace(_MAIL, _M),
    1: _LINES[1].replace(_MAIL, _M).replace(_HOST, _H),
    2: _LINES[2].replace(_HOST, _H),
    3: _LINES[3].replace(_MAIL, _M),
    6: _LINES[6].replace(_MAIL, _M).replace(_HOST, _H),
}
_MASKED_LINE = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {_MASKED.get(k, e)}" for k, e in _LINES.items()) + " END"


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_LINE_EXPR).alias("line"))


def _mask_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files, written, read as lines and masked."""
    path = shared_folder(spark, "log")
    _log_lines(spark, sf_dir).select("line").write.text(path)
    lines = readers.read_text_docs(spark, path, suffix=".txt", whole=False).withColumnRenamed("text", "line")
    masked = formats.mask_log(lines, _PLAIN).withColumn("detector_counts", counts_text())
    return masked.groupBy("line", "matches_applied", "detector_counts").agg(F.count(F.lit(1)).alias("n"))


def _log_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _log_lines(spark, sf_dir)
    parts = formats.split_log_line(F.col("line"))
    return lines.select("event_id", formats.log_line_class(F.col("line")).alias("line_class"), parts["message"].alias("message"))


# The optional logger part of a prefix swallows a leading word and its colon.
_SWALLOWED = "'2024-01-15 10:23:45 10.0.0.' || cast(event_id % 256 as string) || ' : from 10.1.1.1'"


def _log_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_SWALLOWED).alias("line"))
    loose = formats.mask_log(lines, _PLAIN).select("event_id", F.col("line").alias("by_prefix"))
    strict = formats.mask_log(lines, _PLAIN, strict=True).select("event_id", F.col("line").alias("whole_line"))
    return loose.join(strict, "event_id")


_ORDER_MAIL = "'u' || cast(o_custkey as string) || '@mail.ru'"
_SQL_EXPR = (
    f"'INSERT INTO t VALUES (' || cast(o_orderkey as string) || ', ''' || {_ORDER_MAIL} || ''', ''it''''s 10.0.0.1'', ' || "
    f"{_ORDER_MAIL} || ', 7707083893, ''''); -- ' || {_ORDER_MAIL} || CASE WHEN o_orderkey % 3 = 0 THEN ' ''open ' || {_ORDER_MAIL} ELSE '' END"
)


def _mask_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL dump, written, read as lines and masked inside its literals."""
    path = shared_folder(spark, "sql")
    table(spark, sf_dir, "orders").select(F.expr(_SQL_EXPR).alias("line")).write.text(path)
    lines = readers.read_sql_dump(spark, path, suffix=".txt")
    masked = formats.mask_sql_dump(lines.select("line"), _PLAIN)
    return masked.withColumn("detector_counts", counts_text())


# -- whole files, tables, documents ----------------------------------------------------------------


def _mask_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of many lines, read whole; one file report over all of them."""
    path = shared_folder(spark, "docs")
    table(spark, sf_dir, "customer").select(
        F.expr(f"'mail u' || cast({K} as string) || '@mail.ru' || chr(10) || 'id' || chr(10) || 'A' || {num(K, 6)}").alias("text"),
        "c_mktsegment",
    ).write.partitionBy("c_mktsegment").text(path)
    docs = readers.read_text_docs(spark, path, whole=True)
    masked = formats.mask_text_docs(docs, _PLAIN)
    folder = F.regexp_extract("source", "c_mktsegment=([^/]*)", 1).alias("segment")
    return reports.file_report(masked.select("*", folder), "segment").select(
        "segment", "matches_found", "matches_applied", counts_text()
    )


_NULLS = f"""CASE o_orderkey % 3
  WHEN 0 THEN '{{"a":null,"b":{{"c":null,"email":"' || {_ORDER_MAIL} || '"}},"n":[1,null,2.5]}}'
  WHEN 1 THEN '{{"a":[["' || {_ORDER_MAIL} || '",null],[]],"password":["p",7,null,["q"]],"q":"\\\\"' || {_ORDER_MAIL} || '\\\\""}}'
  ELSE '["' || {_ORDER_MAIL} || '",null,{{"password":"p","token":"t","x":true}}]' END"""
_LONG_LINE = f"'user ' || {_MAIL} || ' at ' || {_HOST} || ' ' || repeat('*', cast(event_id % 700 as int)) || {_MAIL}"
_MAIL_OF = f"'u' || cast({K} as string) || '@mail.ru'"
_XML_EXPR = f"""'<?xml version="1.0"?><p:person xmlns:p="http://10.0.0.1" mail="' || {_MAIL_OF} || '" password="x"> <note>to '
  || {_MAIL_OF} || '<b>bold</b>, &lt;' || {_MAIL_OF} || '&gt; </note>' || chr(10) || '<password>secret<i/>more ' || {_MAIL_OF}
  || '</password> <!-- ' || {_MAIL_OF} || ' --> <token>t</token><![CDATA[<a> ' || {_MAIL_OF} || ']]></p:person>'"""
_VARIED = f"""CASE o_orderkey % 5
  WHEN 0 THEN '{{"id":1,"email":"' || {_ORDER_MAIL} || '","any":5}}'
  WHEN 1 THEN '{{"tags":["' || {_ORDER_MAIL} || '",null],"any":"to ' || {_ORDER_MAIL} || '"}}'
  WHEN 2 THEN '{{"user":{{"password":"p","email":"' || {_ORDER_MAIL} || '"}}}}'
  WHEN 3 THEN '{{"any":{{"password":"p","email":"' || {_ORDER_MAIL} || '","token":"t"}}}}'
  ELSE '{{bad ' || {_ORDER_MAIL} END"""


def _mask_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV written, read as strings, masked, written again and read back."""
    source, target = shared_folder(spark, "csv"), shared_folder(spark, "csv-masked")
    rows = people(spark, sf_dir).withColumn("comment", F.concat("comment", F.lit('; "quoted", more\nnext line')))
    sinks.write_masked(rows, source, "csv", delimiter=";")
    masked = formats.mask_csv(readers.read_csv_strings(spark, source, delimiter=";"), POLICY)
    sinks.write_masked(masked, target, "csv", overwrite=True)
    return readers.read_csv_strings(spark, target).drop("c_acctbal")


def _csv_headers_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns are in another order, or lack one: cells stay under their own names."""
    path = shared_folder(spark, "csv-headers")
    rows = people(spark, sf_dir).select(F.col(K).cast("string").alias("id"), "Password", "comment", K)
    for rest, columns in enumerate((["id", "Password", "comment"], ["comment", "id", "Password"], ["Password", "id"])):
        sinks.write_masked(rows.where(F.col(K) % 3 == rest).select(*columns), f"{path}/{rest}", "csv")
    return formats.mask_csv(readers.read_csv_strings(spark, path, columns=["id", "Password", "comment"]), POLICY)


def _log_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files in three encodings, recognised by file, read as lines and masked."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = shared_folder(spark, "log-encodings")
    lines = table(spark, sf_dir, "customer").select(K, F.expr(f"'Иван Шевцов u' || cast({K} as string) || '@mail.ru'").alias("line"))
    for rest, charset in enumerate(("UTF-8", "windows-1251", "IBM866")):
        lines.where(F.col(K) % 3 == rest).select("line").write.option("encoding", charset).csv(f"{path}/{rest}")
    read = readers.read_log(spark, path, suffix=".csv", encoding="detect")
    return formats.mask_log(read, _PLAIN).select("line", "matches_applied")


def _csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files in three encodings with a Cyrillic header, in one folder: each is read in its own."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # to write them
    path = shared_folder(spark, "csv-encodings")
    rows = table(spark, sf_dir, "customer").select(F.col(K).cast("string").alias("id"), F.expr(f"'Иван Шевцов, ' || {_MAIL_OF}").alias("имя"), K)
    for rest, charset in enumerate(("UTF-8", "windows-1251", "IBM866")):
        part = rows.where(F.col(K) % 3 == rest).drop(K)
        part.write.options(header=True, encoding=charset, escape='"').csv(f"{path}/{rest}")
    return formats.mask_csv(readers.read_csv_strings(spark, path), POLICY)


def _read_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and XML documents, some cut off, masked and reported in one pass: failing files are rows of the report."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 10 == 0).alias("cut"), F.expr(_ORDER_MAIL).alias("mail"))
    cut = lambda text: F.when(F.col("cut") & (F.col("o_orderstatus") == "F"), F.left(text, F.length(text) - 2)).otherwise(text)
    json = orders.select(F.concat(F.lit("json "), "o_orderstatus").alias("source"), cut(F.concat(F.lit('{"a":"'), "mail", F.lit('"}'))).alias("text"))
    xml = orders.select(F.concat(F.lit("xml "), "o_orderstatus").alias("source"), cut(F.concat(F.lit("<a>"), "mail", F.lit("</a>"))).alias("text"))
    reports_ = [
        reports.run_report(formats.mask_json(json, _PLAIN, "text", with_stats=True), "source", "json"),
        reports.run_report(formats.mask_xml_text(xml, _PLAIN), "source", "xml"),
    ]
    both = reports_[0].unionByName(reports_[1])
    return both.select("source", "success", "message", "matches_applied", counts_text())


def _csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of which one in three has cells past the header: they are kept and masked."""
    path = shared_folder(spark, "csv-ragged")
    line = f"cast({K} as string) || ',call ' || {_MAIL_OF} || CASE WHEN {K} % 3 = 0 THEN ',' || {_MAIL_OF} || ',7' ELSE '' END"
    lines = table(spark, sf_dir, "customer").select(F.expr(line).alias("id,comment"))
    sinks.write_masked(lines, path, "csv", delimiter="\t")
    return formats.mask_csv(readers.read_csv_strings(spark, path), POLICY)


def _json_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of differing keys and kinds, and some that is none, masked without a schema."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_VARIED).alias("doc"))
    masked = formats.mask_json(docs, POLICY, "doc")
    failed = formats.json_failures(docs, "doc").select("o_orderkey", F.lit(True).alias("failed"))
    return masked.join(failed, "o_orderkey", "left").select("o_orderkey", "doc", F.coalesce("failed", F.lit(False)).alias("failed"))


def _json_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of any shape without a schema: nulls, arrays in arrays, escapes and mixed kinds are kept as they are."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NULLS).alias("doc"))
    return formats.mask_json(docs, POLICY, "doc")


def _text_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long text files in blocks of a few thousand characters, each masked by itself: the lines come out whole."""
    path = shared_folder(spark, "long-texts")
    table(spark, sf_dir, "events").select(F.expr(_LONG_LINE).alias("value")).write.text(path)
    blocks = blocks_of.read_text_blocks(spark, path, block_chars=4000, halo_chars=500)
    masked = blocks_of.mask_text_blocks(blocks, _PLAIN)
    lines = masked.select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _text_splits_unbroken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one endless line, whose blocks are cut at blanks or, in long words, anywhere: statistics of a whole file."""
    path = shared_folder(spark, "unbroken")
    words = table(spark, sf_dir, "events").select(F.expr(f"{_EVENT_TEXT} || ' ' || repeat('x', 3000)").alias("value"))
    words.write.option("lineSep", " ").text(path)
    blocks = blocks_of.read_text_blocks(spark, path, block_chars=2000, halo_chars=200, separator=" ")
    masked = blocks_of.mask_text_blocks(blocks, _PLAIN)
    return masked.agg(
        F.sum("matches_found").alias("matches_found"), F.sum("matches_applied").alias("matches_applied"), F.sum(F.length("text")).alias("n_chars")
    )


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files masked and written again, each under a label of its own."""
    path, out = shared_folder(spark, "log-files"), shared_folder(spark, "log-files-masked")
    lines = _log_lines(spark, sf_dir).select("line", (F.col("event_id") % 3).alias("part"))
    lines.write.partitionBy("part").text(path)
    read = readers.read_log(spark, path, suffix=".txt", with_place=True)
    named = read.withColumn("source", F.concat(F.regexp_extract("source", "part=([^/]*)", 1), F.lit(".log")))
    sinks.write_lines(formats.mask_log(named, _PLAIN), out)
    return spark.read.text(out).select("output", F.col("value").alias("line"))


def _csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header holding an address, masked like a cell."""
    path = shared_folder(spark, "csv-header")
    rows = table(spark, sf_dir, "customer").select(K, F.col("c_name").alias("name of u1@mail.ru"))
    sinks.write_masked(rows, path, "csv")
    return formats.mask_csv(readers.read_csv_strings(spark, path), _PLAIN, mask_header=True)


def _mask_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents written one per line, masked by a given schema."""
    path = shared_folder(spark, "json")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.expr(_ORDER_MAIL).alias("email"), F.lit("p").alias("password")).alias("user"),
        F.expr(f"array({_ORDER_MAIL})").alias("emails"),
        F.col("o_totalprice").alias("price"),
    )
    sinks.write_masked(docs, path, "json")
    schema = "id bigint, user struct<email:string,password:string>, emails array<string>, price double"
    masked = mask_nested(readers.read_json_docs(spark, path, schema, lines=True), POLICY)
    return masked.select("id", F.to_json("user").alias("user_json"), F.to_json("emails").alias("emails_json"), "price")


def _mask_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML rows with attributes and text, masked by attribute and element names."""
    path = shared_folder(spark, "xml")
    rows = people(spark, sf_dir).select(
        F.col(K).alias("_id"),
        F.struct(F.col("contact").alias("_mail"), F.lit("a").alias("_password"), F.col("comment").alias("_VALUE")).alias("note"),
        F.lit("secret").alias("password"),
        F.lit("t").alias("token"),
    )
    sinks.write_masked(rows, path, "xml", row_tag="person")
    schema = "_id string, note struct<_VALUE:string,_mail:string,_password:string>, password string, token string"
    masked = formats.mask_xml(readers.read_xml_rows(spark, path, "person", schema), POLICY)
    return masked.select(
        F.col("_id").cast("bigint").alias("id"), F.to_json("note").alias("note_json"), "password", "token"
    )


def _xml_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML documents as trees: attributes, texts, tails behind inner elements, comments, in their order."""
    docs = people(spark, sf_dir).select(K, F.expr(_XML_EXPR).alias("doc"))
    return formats.mask_xml_text(docs, POLICY, "doc").withColumn("detector_counts", counts_text()).drop("failed")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tree")
    table(spark, sf_dir, "customer").select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").option(
        "header", True
    ).csv(path)
    files = readers.scan_directory(spark, path)
    return files.select(F.regexp_extract("relative_path", "^[^/]*", 0).alias("folder"), "suffix").distinct()


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which one in ten is cut off; the folders play the files."""
    path = shared_folder(spark, "broken")
    text = "'{\"id\":' || cast(o_orderkey as string) || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '}' END"
    lines = table(spark, sf_dir, "orders").select(F.expr(text).alias("value"), "o_orderstatus")
    lines.write.partitionBy("o_orderstatus").text(path)
    bad = readers.ingest_errors(spark, path, "json", lines=True, suffix=".txt")
    return bad.groupBy(F.regexp_extract("source", "o_orderstatus=([^/]*)", 1).alias("status")).agg(
        F.sum("records").alias("n_bad"), F.min(F.substring_index("message", ",", 1)).alias("message")
    )


def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of three encodings, recognised and decoded."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    text = F.expr(f"'Иван Шевцов admin' || cast({K} as string) || '@example.com'")
    content = (
        F.when(F.col(K) % 3 == 0, F.encode(text, "UTF-8"))
        .when(F.col(K) % 3 == 1, F.encode(text, "windows-1251"))
        .otherwise(F.encode(text, "IBM866"))
    )
    return readers.decode_content(table(spark, sf_dir, "customer").select(K, content.alias("content")))


# -- reports as files --------------------------------------------------------------------------------


def _report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File report and audit trail, written as JSON and read back."""
    path, trail = shared_folder(spark, "report"), shared_folder(spark, "audit")
    stats = formats.mask_text_docs(table(spark, sf_dir, "pages").select(F.col("url").alias("source"), F.col("html").alias("text")), _PLAIN)
    files = reports.file_report(stats, "source")
    sinks.write_report(files.withColumn("detector_counts", counts_text()), path)
    written = spark.read.schema("source string, success boolean, matches_found bigint, matches_applied bigint").json(path)
    sinks.append_audit(reports.audit_events(files, "source"), trail)
    events = spark.read.schema("source string, event_type string").json(trail).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return written.join(events, "source").select("source", "success", "matches_found", "matches_applied", "n_events")


# -- streams -----------------------------------------------------------------------------------------

_EVENT_TEXT = f"'user ' || {_MAIL} || ' at ' || {_HOST}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.read_stream(spark, f"{sf_dir}/events.parquet")
    return events.select("event_id", F.expr(_EVENT_TEXT).alias("text"))


def _mask_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = shared_folder(spark, "stream"), shared_folder(spark, "stream-marks")
    masked = streams.mask_stream(_stream(spark, sf_dir), Policy.only(SECRET, "email", "ip_address"))
    streams.write_stream(masked, out, marks).awaitTermination()
    return spark.read.parquet(out).withColumn("detector_counts", counts_text())


def _mapping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = shared_folder(spark, "mapping"), shared_folder(spark, "mapping-marks")
    policy = Policy.only(SECRET, "email", "ip_address")
    streams.mapping_stream(_stream(spark, sf_dir), policy, out, PASSPHRASE, marks).awaitTermination()
    return m.load_mapping(spark, out, PASSPHRASE)


def _mapping_stream_onto_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream onto a store that holds the customers' addresses already: none of them is lost."""
    out, marks = shared_folder(spark, "mapping"), shared_folder(spark, "mapping-marks")
    policy = Policy.only(SECRET, "email", "ip_address")
    held = table(spark, sf_dir, "customer").select(F.expr("'mail c' || cast(c_custkey as string) || '@mail.ru'").alias("text"))
    m.save_mapping(m.build_mapping(held, policy), out, PASSPHRASE, 0)
    streams.mapping_stream(_stream(spark, sf_dir), policy, out, PASSPHRASE, marks).awaitTermination()
    return m.load_mapping(spark, out, PASSPHRASE)


def _cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = shared_folder(spark, "cache"), shared_folder(spark, "cache-marks")
    policy = Policy.only(SECRET, "email", "ip_address")
    streams.token_cache_stream(_stream(spark, sf_dir), policy, out, "event_id", marks).awaitTermination()
    return m.load_token_cache(spark, out).select("token")


QUERIES = {
    "mask_log": _mask_log,
    "log_line_class": _log_class,
    "mask_log_strict": _log_strict,
    "mask_sql_dump": _mask_sql,
    "mask_text_docs": _mask_docs,
    "mask_csv": _mask_csv,
    "mask_csv_header": _csv_header,
    "mask_csv_headers_differ": _csv_headers_differ,
    "mask_log_encodings": _log_encodings,
    "mask_log_files": _log_files,
    "mask_csv_ragged": _csv_ragged,
    "mask_csv_encodings": _csv_encodings,
    "read_failures": _read_failures,
    "mask_json_varied": _json_varied,
    "mask_json_nulls": _json_nulls,
    "mask_text_splits": _text_splits,
    "mask_text_splits_unbroken": _text_splits_unbroken,
    "mapping_stream_onto_store": _mapping_stream_onto_store,
    "mask_json_files": _mask_json,
    "mask_xml": _mask_xml,
    "mask_xml_tree": _xml_tree,
    "scan_directory": _scan,
    "ingest_errors": _errors,
    "decode_text_files": _decode,
    "write_report": _report_files,
    "mask_stream": _mask_stream,
    "mapping_stream": _mapping_stream,
    "token_cache_stream": _cache_stream,
}

_APPLIED = "CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 6 THEN 2 ELSE 0 END"
_COUNTS = (
    "CASE event_id % 8 WHEN 0 THEN 'email:1' WHEN 1 THEN 'email:1,ip_address:1' WHEN 2 THEN 'ip_address:1' "
    "WHEN 3 THEN 'email:1' WHEN 6 THEN 'email:1,ip_address:1' ELSE '' END"
)
_HEADER_TOKEN = "EMAIL_" + hmac.new(SECRET.encode(), b"u1@mail.ru", hashlib.sha256).hexdigest()[:24]
_OM = token_sql(_ORDER_MAIL, "EMAIL")
_PEOPLE_MAIL = token_sql(f"'u' || {K} || '@mail.ru'", "EMAIL")
_PEOPLE_HOST = token_sql(f"'10.0.0.' || ({K} % 256)", "IP")
_STREAM_MAIL, _STREAM_HOST = token_sql(_MAIL, "EMAIL"), token_sql(_HOST, "IP")
ORACLES = {
    "mask_log": f"""
SELECT line, matches_applied, detector_counts, count(*) AS n
FROM (SELECT {_MASKED_LINE} AS line, {_APPLIED} AS matches_applied, {_COUNTS} AS detector_counts FROM events) GROUP BY ALL""",
    "log_line_class": f"""
SELECT event_id, CASE event_id % 8 WHEN 4 THEN 'trace' WHEN 5 THEN 'trace' WHEN 6 THEN 'plain' ELSE 'prefixed' END AS line_class,
  CASE event_id % 8 WHEN 0 THEN 'login ' || {_MAIL} WHEN 1 THEN {_MAIL} || ': failed from ' || {_HOST} WHEN 2 THEN {_HOST} || ' GET /'
    WHEN 3 THEN {_MAIL} WHEN 6 THEN {_LINES[6]} WHEN 7 THEN '' END AS message FROM events""",
    "mask_log_strict": f"""
SELECT event_id, '2024-01-15 10:23:45 10.0.0.' || (event_id % 256) || ' : from ' || {token_sql("'10.1.1.1'", 'IP')} AS by_prefix,
  '2024-01-15 10:23:45 ' || {token_sql("'10.0.0.' || (event_id % 256)", 'IP')} || ' : from ' || {token_sql("'10.1.1.1'", 'IP')} AS whole_line
FROM events""",
    "mask_sql_dump": f"""
SELECT 'INSERT INTO t VALUES (' || o_orderkey || ', ''' || {_OM} || ''', ''it''''s ' || {token_sql("'10.0.0.1'", 'IP')} || ''', ' || {_ORDER_MAIL}
  || ', 7707083893, ''''); -- ' || {_ORDER_MAIL} || CASE WHEN o_orderkey % 3 = 0 THEN ' ''open ' || {_ORDER_MAIL} ELSE '' END AS line,
  2 AS matches_found, 2 AS matches_applied, 0 AS matches_skipped, 'email:1,ip_address:1' AS detector_counts FROM orders""",
    "mask_text_docs": """
SELECT c_mktsegment AS segment, 2 * count(*) AS matches_found, 2 * count(*) AS matches_applied,
  'document_code:' || count(*) || ',email:' || count(*) AS detector_counts FROM customer GROUP BY c_mktsegment""",
    "mask_csv": f"""
SELECT CAST({K} AS VARCHAR) AS {K}, {_PEOPLE_MAIL} AS contact,
  'call ' || {_PEOPLE_MAIL} || ' from ' || {_PEOPLE_HOST} || '; "quoted", more' || chr(10) || 'next line' AS comment, '' AS "Password",
  '[hidden]' AS token, '' AS empty_token, CASE WHEN {K} % 2 = 0 THEN '=' ELSE '' END || 'A1 & ' || {_PEOPLE_HOST} AS formula FROM customer""",
    # The number in a customer's name has the shape of a bank code.
    "mask_csv_header": f"""
SELECT CAST({K} AS VARCHAR) AS {K}, 'Customer#' || {token_sql('substr(c_name, 10)', 'BIK')} AS "name of {_HEADER_TOKEN}" FROM customer""",
    "mask_json_files": f"""
SELECT o_orderkey AS id, '{{"email":"' || {_OM} || '"}}' AS user_json, '["' || {_OM} || '"]' AS emails_json, o_totalprice AS price FROM orders""",
    "mask_xml": f"""
SELECT {K} AS id, '{{"_VALUE":"call ' || {_PEOPLE_MAIL} || ' from ' || {_PEOPLE_HOST} || '","_mail":"' || {_PEOPLE_MAIL} || '"}}' AS note_json,
  '' AS password, '[hidden]' AS token FROM customer""",
    "mask_xml_tree": f"""
SELECT {K}, '<?xml version="1.0"?><p:person xmlns:p="http://10.0.0.1" mail="' || {_PEOPLE_MAIL} || '"> <note>to '
  || {_PEOPLE_MAIL} || '<b>bold</b>, &lt;' || {_PEOPLE_MAIL} || '&gt; </note>' || chr(10) || '<password><i/>more ' || {_MAIL_OF}
  || '</password> <!-- ' || {_PEOPLE_MAIL} || ' --> <token>[hidden]</token>&lt;a&gt; ' || {_PEOPLE_MAIL} || '</p:person>' AS doc,
  5 AS matches_found, 5 AS matches_applied, 0 AS matches_skipped, 'email:5' AS detector_counts FROM customer""",
    "scan_directory": "SELECT DISTINCT 'c_mktsegment=' || c_mktsegment AS folder, '.csv' AS suffix FROM customer",
    "ingest_errors": """
SELECT o_orderstatus AS status, count(*) AS n_bad, 'ValueError: malformed json' AS message FROM orders WHERE o_orderkey % 10 = 0
GROUP BY o_orderstatus""",
    "decode_text_files": f"""
SELECT {K}, 'Иван Шевцов admin' || {K} || '@example.com' AS text,
  CASE {K} % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1251' ELSE 'cp866' END AS encoding FROM customer""",
    "write_report": f"""
WITH {resolved_ctes("SELECT page_id AS key, html AS text FROM pages", *DETECTORS)}, stats AS ({stats_sql()})
SELECT p.url AS source, true AS success, CAST(sum(s.matches_found) AS BIGINT) AS matches_found,
  CAST(sum(s.matches_applied) AS BIGINT) AS matches_applied, 2 AS n_events
FROM stats s JOIN pages p ON p.page_id = s.key GROUP BY p.url""",
    "mask_stream": f"""
SELECT event_id, 'user ' || {_STREAM_MAIL} || ' at ' || {_STREAM_HOST} AS text, 2 AS matches_found, 2 AS matches_applied, 0 AS matches_skipped,
  'email:1,ip_address:1' AS detector_counts FROM events""",
    "mapping_stream": f"""
SELECT DISTINCT {_STREAM_MAIL} AS token, {_MAIL} AS value FROM events
UNION SELECT DISTINCT {_STREAM_HOST}, {_HOST} FROM events""",
    "mapping_stream_onto_store": f"""
SELECT DISTINCT {_STREAM_MAIL} AS token, {_MAIL} AS value FROM events
UNION SELECT DISTINCT {_STREAM_HOST}, {_HOST} FROM events
UNION SELECT {token_sql("'c' || c_custkey || '@mail.ru'", 'EMAIL')}, 'c' || c_custkey || '@mail.ru' FROM customer""",
    "mask_csv_headers_differ": f"""
SELECT CAST({K} AS VARCHAR) AS id, '' AS "Password",
  CASE WHEN {K} % 3 = 2 THEN '' ELSE 'call ' || {_PEOPLE_MAIL} || ' from ' || {_PEOPLE_HOST} END AS comment FROM customer""",
    "mask_log_files": f"SELECT (event_id % 3) || '.masked.log' AS output, {_MASKED_LINE} AS line FROM events",
    "mask_csv_encodings": f"""
SELECT CAST({K} AS VARCHAR) AS id, 'Иван Шевцов, ' || {_PEOPLE_MAIL} AS "имя" FROM customer""",
    "read_failures": """
SELECT kind || o_orderstatus AS source, n_bad = 0 AS success,
  CASE WHEN n_bad = 0 THEN 'OK' ELSE 'ValueError: malformed ' || trim(kind) || ', records: ' || n_bad END AS message,
  CASE WHEN n_bad = 0 THEN n ELSE 0 END AS matches_applied, CASE WHEN n_bad = 0 THEN 'email:' || n ELSE '' END AS detector_counts
FROM (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 10 = 0 AND o_orderstatus = 'F') AS n_bad FROM orders GROUP BY o_orderstatus),
  (VALUES ('json '), ('xml ')) k(kind)""",
    "mask_csv_ragged": f"""
SELECT CAST({K} AS VARCHAR) AS id, 'call ' || {_PEOPLE_MAIL} AS comment, CASE WHEN {K} % 3 = 0 THEN {_PEOPLE_MAIL} ELSE '' END AS extra_1,
  CASE WHEN {K} % 3 = 0 THEN '7' ELSE '' END AS extra_2 FROM customer""",
    "mask_json_varied": f"""
SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN '{{"any":5,"email":"' || {_OM} || '","id":1}}'
  WHEN 1 THEN '{{"any":"to ' || {_OM} || '","tags":["' || {_OM} || '",null]}}'
  WHEN 2 THEN '{{"user":{{"email":"' || {_OM} || '"}}}}'
  WHEN 3 THEN '{{"any":{{"email":"' || {_OM} || '","token":"[hidden]"}}}}' END AS doc, o_orderkey % 5 = 4 AS failed FROM orders""",
    "mask_json_nulls": f"""
SELECT o_orderkey, CASE o_orderkey % 3
  WHEN 0 THEN '{{"a":null,"b":{{"c":null,"email":"' || {_OM} || '"}},"n":[1,null,2.5]}}'
  WHEN 1 THEN '{{"a":[["' || {_OM} || '",null],[]],"password":[7,null,[]],"q":"\\"' || {_OM} || '\\""}}'
  ELSE '["' || {_OM} || '",null,{{"token":"[hidden]","x":true}}]' END AS doc FROM orders""",
    "mask_text_splits": f"""
SELECT line, count(*) AS n FROM (
  SELECT 'user ' || {_STREAM_MAIL} || ' at ' || {_STREAM_HOST} || ' ' || repeat('*', CAST(event_id % 700 AS INT)) || {_STREAM_MAIL} AS line
  FROM events) GROUP BY line""",
    "mask_text_splits_unbroken": f"""
SELECT 2 * count(*) AS matches_found, 2 * count(*) AS matches_applied,
  sum(length('user ' || {_STREAM_MAIL} || ' at ' || {_STREAM_HOST} || ' ') + 3001) AS n_chars FROM events""",
    "mask_log_encodings": f"SELECT 'Иван Шевцов ' || {_PEOPLE_MAIL} AS line, 1 AS matches_applied FROM customer",
    "token_cache_stream": f"""
SELECT DISTINCT {_STREAM_MAIL} AS token FROM events UNION SELECT DISTINCT {_STREAM_HOST} FROM events""",
}
