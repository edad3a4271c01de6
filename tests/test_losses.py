"""Inputs that once leaked or lost something."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import mapping, ner
from cloakframe.operators.fields import mask_table
from cloakframe.operators.reports import batch_document, batch_report, column_profile, file_report
from cloakframe.plans.extend import register_detector
from cloakframe.plans.masking import mask_with_stats
from cloakframe.plans.policy import FieldRule, Policy
from cloakframe.sources.formats import json_failures, mask_csv, mask_json, mask_log
from cloakframe.sources.readers import read_csv_strings, read_log
from cloakframe.sources.sinks import write_lines
from cloakframe.streaming.streams import mapping_stream, token_cache_stream

POLICY = Policy.only("secret", "email")


def masked(spark, texts, policy=POLICY):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.text for r in mask_with_stats(df, policy, text="text").collect()]


def test_bytes_that_are_no_utf8_shift_nothing(spark):
    df = spark.range(1).select(F.concat(F.unhex(F.lit("C8E2E0ED20")), F.lit("admin@example.com!").cast("binary")).cast("string").alias("text"))
    text = mask_with_stats(df, POLICY, text="text").first().text
    assert "@" not in text and "adm" not in text and text.startswith("�") and text.endswith("!")


def test_log_in_another_encoding(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("Иван admin@example.com\r\nдва\r\n".encode("cp1251"))
    (tmp_path / "b.log").write_bytes("три".encode())
    lines = {r.line for r in read_log(spark, str(tmp_path), encoding="detect").collect()}
    assert lines == {"Иван admin@example.com", "два", "три"}


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,password,note\n1,p1,"n\n1"\n')
    (tmp_path / "b.csv").write_text("id,note,password\n2,n2,p2\n")
    (tmp_path / "c d.csv").write_text("id,extra\n3,x\n")
    rows = {r.id: (r.password, r.note, r.extra) for r in read_csv_strings(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("p1", "n\n1", ""), "2": ("p2", "n2", ""), "3": ("", "", "x")}
    some = read_csv_strings(spark, str(tmp_path), columns=["note", "none"], with_source=True)
    assert some.columns == ["note", "none", "source"] and some.count() == 3


def test_groups_inside_a_match_and_empty_matches(spark):
    policy = register_detector(Policy(secret="s"), "tag", r"<(\w+)>", group=1)
    policy = Policy(secret="s", registry=policy.registry, rules={"tag": policy.rules["tag"]})
    (text,) = masked(spark, ["<abc> x <de>=1"], policy)
    assert text.startswith("<") and "> x <" in text and "abc" not in text
    for pattern in ("z*", "a|"):
        with pytest.raises(ValueError):
            register_detector(Policy(secret="s"), "empty", pattern)
    optional = register_detector(Policy(secret="s"), "maybe", r"a(b)?", group=1)
    assert masked(spark, ["a"], optional) == ["a"]


def test_null_keys_are_restored(spark):
    df = spark.createDataFrame([(None, "mail a@b.ru"), (1, "mail c@d.ru")], "id long, text string")
    tokens = mapping.build_mapping(df, POLICY)
    hidden = mask_with_stats(df, POLICY, text="text").select("id", "text")
    restored = mapping.demask(hidden, tokens, POLICY.hmac_prefixes().values()).collect()
    assert {r.text for r in restored} == {"mail a@b.ru", "mail c@d.ru"} and all(r.replacements == 1 for r in restored)


def test_cached_tokens_are_restored(spark):
    df = spark.createDataFrame([(1, "mail a@b.ru")], "id long, text string")
    digest = mapping.keyed_spans(df, POLICY).first().digest
    cache = spark.createDataFrame([(digest, "EMAIL_" + "a" * 24)], "digest string, token string")
    hidden = mapping.mask_with_cache(df, POLICY, "id", cache=cache)
    assert "EMAIL_aaaa" in hidden.first().text
    tokens = mapping.build_mapping(df, POLICY, cache=cache, order=["id"])
    assert mapping.demask(hidden, tokens, ["EMAIL"]).first().text == "mail a@b.ru"


def test_streams_rewrite_nothing_stored(spark, tmp_path):
    source, store, cache = (str(tmp_path / n) for n in ("in", "store", "cache"))
    first = spark.createDataFrame([(1, "a@b.ru")], "id long, text string")
    mapping.save_mapping(mapping.build_mapping(first, POLICY), store, "key", 0)
    entries = mapping.cache_entries(mapping.keyed_spans(first, POLICY, keys=["id"]), ["id"])
    mapping.save_token_cache(entries, cache, 0)
    spark.createDataFrame([(2, "c@d.ru")], "id long, text string").write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, text string").parquet(source)
    mapping_stream(stream(), POLICY, store, "key", str(tmp_path / "m1")).awaitTermination()
    token_cache_stream(stream(), POLICY, cache, "id", str(tmp_path / "m2")).awaitTermination()
    assert {r.value for r in mapping.load_mapping(spark, store, "key").collect()} == {"a@b.ru", "c@d.ru"}
    assert mapping.load_token_cache(spark, cache).count() == 2
    mapping.compact_mapping(spark, store, str(tmp_path / "compact"))
    assert mapping.load_mapping(spark, str(tmp_path / "compact"), "key").count() == 2


def test_reports_keep_unlisted_detectors(spark):
    rows = [("f", 2, 2, 0, {"email": 1, "document": 1}), ("f", 1, 1, 0, {"person": 1}), ("g", 0, 0, 0, {})]
    kinds = "source string, matches_found long, matches_applied long, matches_skipped long, detector_counts map<string,long>"
    files = file_report(spark.createDataFrame(rows, kinds), "source")
    got = {r.source: (r.matches_found, r.detector_counts) for r in files.collect()}
    assert got == {"f": (3, {"email": 1, "document": 1, "person": 1}), "g": (0, {})}
    totals = batch_report(files).first()
    assert (totals.total, totals.success, totals.total_matches_applied) == (2, 2, 3) and totals.detector_totals["person"] == 1
    assert batch_report(files.limit(0)).first().detector_totals == {}
    assert batch_document(files).count() == 3


def test_entities_of_null_keys_and_refused_ones(spark):
    docs = spark.createDataFrame([(None, "Anna and " + "x" * 200)], "doc_id long, text string")
    found = spark.createDataFrame(
        [(None, "person", 0, 4, "Anna"), (None, "person", 9, 209, "x" * 200)],
        "doc_id long, entity_type string, start int, end int, value string",
    )
    assert len(ner.ner_spans(docs, found).first().entities) == 1
    assert len(ner.ner_spans(docs, found, max_length=300).first().entities) == 2
    assert ner.ner_refused(docs, found).first().start == 9


def test_null_keys_go_from_candidates_to_the_masked_text(spark):
    text = "Anna " + "x " * 3000 + "Anna"
    docs = spark.createDataFrame([(None, text), (1, "Anna")], "doc_id long, text string")
    rows = [(k, "person", s, s + 4, "Anna", "m", 0.9, 1) for k, s in ((None, 0), (None, len(text) - 4), (1, 0))]
    kinds = "doc_id long, entity_type string, start int, end int, value string, source string, confidence double, priority int"
    resolved = ner.ner_resolve(spark.createDataFrame(rows, kinds))
    assert resolved.count() == 3
    hidden = mask_with_stats(ner.ner_spans(docs, resolved), Policy.only("secret", ner=True), extra="entities").collect()
    assert len(hidden) == 2 and not any("Anna" in r.text for r in hidden)


def test_policy_threshold_is_used(spark):
    rows = [(1, "person", 0, 4, "Anna", "m", 0.3, 1)]
    kinds = "doc_id long, entity_type string, start int, end int, value string, source string, confidence double, priority int"
    candidates = spark.createDataFrame(rows, kinds)
    assert ner.ner_resolve(candidates).count() == 1
    assert ner.ner_resolve(candidates, policy=Policy(secret="s", min_confidence=0.5)).count() == 0


def test_no_key_in_plans(spark):
    sealed = mapping.encrypt_mapping(spark.createDataFrame([("t", "v")], "token string, value string"), "passphrase")
    text = sealed._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    )
    import hashlib

    assert hashlib.sha256(b"passphrase").hexdigest() not in text.lower()


def test_no_shuffle_under_masking(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mask_with_stats(df, POLICY, text="text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rows_without_tokens_and_empty_tables_are_kept(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (2, "plain_text"), (2, "mail a@b.ru, a@b.ru")], "id long, text string")
    tokens = mapping.build_mapping(df, POLICY)
    hidden = mask_with_stats(df, POLICY, text="text").select("id", "text")
    restored = mapping.demask(hidden, tokens, ["EMAIL"])
    assert {(r.id, r.text, r.replacements) for r in restored.collect()} == {(1, None, 0), (1, "", 0), (2, "plain_text", 0), (2, "mail a@b.ru, a@b.ru", 2)}
    assert mapping.demask(hidden, tokens.limit(0), ["EMAIL"]).where("text like '%EMAIL_%'").count() == 1
    assert mapping.demask(hidden.limit(0), tokens, ["EMAIL"]).count() == 0


def test_wide_tables_detect_once(spark):
    """The plan of a masked table does not grow with a copy of the detection for each column."""
    size = lambda n: len(mask_table(spark.range(1).select(*[F.lit("a@b.ru").alias(f"c{i}") for i in range(n)]), POLICY)._jdf.queryExecution().analyzed().toString())
    assert size(40) < 3 * size(4)
    profile = column_profile(spark.createDataFrame([], "a string, b string"), POLICY).collect()
    assert {(r.column_name, r.cells, r.hit_share) for r in profile} == {("a", 0, None), ("b", 0, None)}


def test_cells_past_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"a,b,c",x@mail.ru,\n2\n3,"q\nw",,y\n')
    (tmp_path / "b.csv").write_text('id,note\n4,"z,z,z"\n')
    rows = read_csv_strings(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {
        ("1", "a,b,c", "x@mail.ru", ""), ("2", "", "", ""), ("3", "q\nw", "", "y"), ("4", "z,z,z", "", "")
    }
    assert "@" not in "".join(map(str, mask_csv(rows, POLICY).collect()))


def test_json_of_any_shape(spark):
    rows = ['{"k":1,"m":"a@b.ru"}', '{"m":{"Password":"p","l":[1,"c@d.ru"]}}', '{"m":["e@f.ru",{"password":["q"],"n":2}]}', "{bad g@h.ru", None]
    rules = {"password": FieldRule(action="remove")}
    policy = Policy(secret="s", rules=POLICY.rules, field_rules=rules)
    docs = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [r.j for r in mask_json(docs, policy, "j").collect()]
    assert "@" not in str(got) and "Password" not in str(got) and "q" not in got[2]
    assert got[0].startswith('{"k":1,"m":"EMAIL_') and got[1].startswith('{"m":{"l":[1,"EMAIL_') and got[2].endswith('"password":[]}]}')
    assert got[3:] == [None, None] and json_failures(docs, "j").count() == 1
    top = mask_json(spark.createDataFrame([('["a@b.ru"]',), ("5",), ('"c@d.ru"',), ('{"password":"p"}',)], "j string"), policy, "j")
    assert [r.j[:7] for r in top.collect()] == ['["EMAIL', "5", '"EMAIL_', "{}"]
    assert mask_json(docs.limit(0), policy, "j").count() == 0
    for text in ("{}", "[]", "5", '{"a":null}', '{"a":{},"b":[]}'):
        assert mask_json(spark.createDataFrame([(text,)], "j string"), policy, "j").first().j in (text, "{}")


def test_lines_keep_their_file_and_order(spark, tmp_path):
    for n in "pq":
        (tmp_path / f"{n}.log").write_text("".join(f"{n} {i} u{i}@mail.ru\n" for i in range(50)))
    out = tmp_path / "out"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for encoding in ("utf-8", "detect"):
            lines = read_log(spark, str(tmp_path), encoding=encoding, with_place=True)
            write_lines(mask_log(lines, POLICY), str(out), overwrite=True)
            for n in "pq":
                parts = sorted((out / f"output={n}.masked.log").glob("part-*"))
                got = [line.split() for part in parts for line in part.read_text().splitlines()]
                assert [g[:2] for g in got] == [[n, str(i)] for i in range(50)] and "@" not in str(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
