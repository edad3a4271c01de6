"""Lines, literals, documents and files in the corner cases the table queries do not reach."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import mapping
from cloakframe.operators.fields import mask_nested
from cloakframe.operators.reports import batch_report, file_report
from cloakframe.plans.policy import FieldRule, Policy
from cloakframe.session import shared_folder
from cloakframe.sources import readers, sinks
from cloakframe.sources.formats import SQL_LITERAL, log_line_class, mask_sql_dump, split_log_line

POLICY = Policy.default("secret")


def test_log_lines(spark):
    cases = [
        ("2024-01-15 10:23:45 INFO root - hello a@b.ru", "prefixed", "hello a@b.ru"),
        ("2024-01-15T10:23:45.123+03:00 [WARN] hello", "prefixed", "hello"),
        ("[15/Jan/2024:10:23:45 +0000] GET /", "prefixed", "GET /"),
        ("{10:23:45.123-0,PROC,5}x", "prefixed", "x"),
        ("2024-01-15 10:23:45", "plain", "2024-01-15 10:23:45"),
        ("\tat com.example.Main(Main.java:1)", "trace", None),
        ('  File "/srv/a.py", line 1', "trace", None),
        ("... 12 more", "trace", None),
        ("   ...", "trace", None),
        ("at the start", "plain", "at the start"),
        ("", "plain", ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    rows = df.select("i", log_line_class(F.col("line")).alias("k"), split_log_line(F.col("line"))["message"].alias("m"))
    assert [(r.k, r.m) for r in rows.orderBy("i").collect()] == [c[1:] for c in cases]


def test_sql_literals(spark):
    cases = {
        "'a'": ["'a'"],
        "'it''s' 'b'": ["'it''s'", "'b'"],
        r"'a\'b'": [r"'a\'b'"],
        "'open": [],
        "'a''open": ["'a'"],
        "'a''b''open": ["'a''b'"],
        r"'a''b\x'": ["'a'", r"'b\x'"][:1],
        "'' ''''": ["''", "''''"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, line string")
    rows = df.select("i", F.regexp_extract_all("line", F.lit(SQL_LITERAL), F.lit(0)).alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == list(cases.values())
    long = "INSERT ('" + "x''" * 20_000 + "', 'a@b.ru')"
    out = mask_sql_dump(spark.createDataFrame([(long,)], "line string"), POLICY).first()
    assert out.matches_applied == 1 and out.line.startswith("INSERT ('x''x''") and "a@b.ru" not in out.line


def test_remove_leaves_other_kinds(spark):
    docs = ['{"password": {"note": "a@b.ru"}, "n": {"password": 5, "token": null}, "list": [["a@b.ru"], ["x"]]}']
    schema = "password struct<note:string>, n struct<password:int,token:string>, list array<array<string>>"
    df = spark.createDataFrame([(d,) for d in docs], "v string").select(F.from_json("v", schema).alias("d")).select("d.*")
    policy = POLICY.with_field_rules(
        password=FieldRule(action="remove"), token=FieldRule(action="replace", replacement="t"), list=FieldRule(action="remove")
    )
    row = mask_nested(df, policy).first().asDict(recursive=True)
    assert row["password"]["note"].startswith("EMAIL_")
    assert row["n"] == {"password": 5, "token": None}
    assert row["list"] == [[], []]


def test_store_keeps_no_plain_text(spark):
    path = shared_folder(spark, "store")
    known = spark.createDataFrame([("EMAIL_1", "a@b.ru"), ("EMAIL_2", "c@d.ru")], "token string, value string")
    mapping.save_mapping(known, path, "key", 0)
    raw = spark.read.parquet(path)
    assert "value" not in raw.columns
    # Single bytes of a value may occur in a ciphertext by chance, whole values do not.
    assert not [r for r in raw.collect() for v in (b"a@b.ru", b"c@d.ru") if v in bytes(r.value_enc)]
    newer = known.where("token = 'EMAIL_2'").withColumn("value", F.lit("e@f.ru"))
    mapping.save_mapping(newer, path, "key", 1)
    got = {r.token: r.value for r in mapping.load_mapping(spark, path, "key").collect()}
    assert got == {"EMAIL_1": "a@b.ru", "EMAIL_2": "e@f.ru"}
    with pytest.raises(Exception, match="(?i)aes|crypt|key"):
        mapping.load_mapping(spark, path, "wrong").collect()
    with pytest.raises(ValueError):
        mapping.encrypt_mapping(known, "")


def test_existing_output_is_refused(spark):
    path = shared_folder(spark, "out")
    df = spark.createDataFrame([("a",)], "v string")
    sinks.write_masked(df, path, "json")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_masked(df, path, "json")
    sinks.write_masked(df, path, "json", overwrite=True)
    with pytest.raises(ValueError):
        sinks.write_masked(df, path, "docx")


def test_malformed_files_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.json").write_text('{"a": [1, 2]}')
    (tmp_path / "sub" / "bad.JSON").write_text('{"a": ')
    (tmp_path / "good.xml").write_text("<a><b>1</b></a>")
    (tmp_path / "bad.xml").write_text("<a><b>1</a>")
    for kind, name in (("json", "bad.JSON"), ("xml", "bad.xml")):
        rows = readers.ingest_errors(spark, str(tmp_path), kind).collect()
        assert [r.source.rsplit("/", 1)[1] for r in rows] == [name]
    files = readers.scan_directory(spark, str(tmp_path)).collect()
    assert {(r.relative_path, r.suffix) for r in files} == {
        ("good.json", ".json"), ("sub/bad.JSON", ".json"), ("good.xml", ".xml"), ("bad.xml", ".xml")
    }


def test_encodings(spark, tmp_path):
    text = "Шифр: Иван admin@example.com"
    for name in ("utf-8", "utf-8-sig", "cp1251", "cp866"):
        (tmp_path / f"{name}.txt").write_bytes(text.encode(name))
    rows = {r.source.rsplit("/", 1)[1][:-4]: r for r in readers.decode_text_files(spark, str(tmp_path)).collect()}
    assert {n: r.encoding for n, r in rows.items()} == {
        "utf-8": "utf-8", "utf-8-sig": "utf-8", "cp1251": "cp1251", "cp866": "cp866"
    }
    assert {r.text.lstrip("﻿") for r in rows.values()} == {text}


def test_empty_batch(spark):
    stats = spark.createDataFrame(
        [], "source string, matches_found long, matches_applied long, matches_skipped long, detector_counts map<string,long>"
    )
    row = batch_report(file_report(stats, "source")).first()
    assert (row.total, row.failed, row.total_matches_found, row.detector_totals) == (0, 0, 0, {})


def test_demask_longest_key(spark):
    df = spark.createDataFrame([("ABC AB A",)], "t string")
    row = df.select(mapping.demask_with_keys(F.col("t"), {"A": "1", "AB": "2", "ABC": "3"}).alias("r")).first().r
    assert (row.text, row.replacements) == ("3 2 1", 3)
    many = {f"T_{i}_": str(i) for i in range(1000)}
    row = spark.createDataFrame([(" ".join(f"T_{i}_" for i in range(0, 1000, 100)),)], "t string").select(
        mapping.demask_with_keys(F.col("t"), many).alias("r")
    ).first().r
    assert row.text == " ".join(str(i) for i in range(0, 1000, 100)) and row.replacements == 10
