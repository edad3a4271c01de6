"""Work is dealt over the cores, nothing that grows with the rows is broadcast, and texts are cut in one scan."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.spans import replace_spans
from cloakframe.operators import mapping as m
from cloakframe.operators.restore import demask_any_keys
from cloakframe.plans.masking import findings, mask_with_stats
from cloakframe.plans.policy import Policy
from cloakframe.sources.readers import dealt

SECRET = "a secret for the tests"


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """One file of one row group, as a small table is written."""
    path = str(tmp_path_factory.mktemp("scale") / "customers")
    text = F.expr("'mail u' || id || '@mail.ru, БИК 0' || lpad(cast(id as string), 8, '0')")
    spark.range(2000).select("id", text.alias("text")).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_one_file_is_dealt_over_the_cores(spark, customers):
    rows = dealt(customers).select("id", F.spark_partition_id().alias("p"))
    assert rows.select("p").distinct().count() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in rows.collect()) == list(range(2000))


def test_as_many_files_as_cores_stay(spark, customers, tmp_path):
    customers.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    assert "RoundRobin" not in _plan(dealt(spark.read.parquet(str(tmp_path / "many"))))


def test_tables_of_queries_are_dealt(spark, customers, tmp_path):
    from queries.sqlkit import table

    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert "RoundRobin" in _plan(table(spark, str(tmp_path), "customer"))


def test_keys_of_any_shape_are_not_broadcast(customers):
    keys = customers.select(F.concat(F.lit("u"), "id").alias("token"), F.lit("x").alias("value"))
    restored = demask_any_keys(customers, keys)
    assert "BroadcastHashJoin" not in _plan(restored)
    assert restored.where("replacements = 1 AND text LIKE 'mail x@mail.ru, %'").count() == 2000


def test_spans_are_not_broadcast(customers):
    """Joins of what rows are made into; the last one, to the rows themselves, is left to AQE."""
    policy = Policy.only(SECRET, "bik", "email")
    assert "Inner, Build" not in _plan(m.mask_with_cache(customers, policy, "id"))
    known = m.build_mapping(customers, policy, order=["id"])
    assert "Inner, Build" not in _plan(known)
    masked = mask_with_stats(customers, policy).select("id", "text")
    assert "Inner, Build" not in _plan(m.demask(masked, known, list(policy.hmac_prefixes().values())))


def test_spans_are_found_after_dealing(customers):
    """No filter for nulls holds the whole detection and goes below the dealing, where one task would do it."""
    plan = _plan(m.mask_with_cache(dealt(customers), Policy.only(SECRET, "bik", "email"), "id"))
    below = [part[: part.index("FileScan")] for part in plan.split("RoundRobinPartitioning")[1:]]
    assert below and not any("makeValid" in part for part in below)


def test_texts_without_spans_are_masked_with_a_cache(spark):
    rows = spark.createDataFrame([(1, "none"), (2, None), (3, ""), (None, "a@b.ru"), (None, "a@b.ru")], "id long, text string")
    masked = m.mask_with_cache(dealt(rows), Policy.only(SECRET, "bik", "email"), "id").collect()
    assert sorted(r.text or "" for r in masked)[:3] == ["", "", sorted(r.text for r in masked if r.id is None)[0]]
    assert [r.text for r in masked if r.id == 1] == ["none"] and len(masked) == 5


def test_texts_of_few_spans_are_cut_as_strings(spark):
    """Up to a number of spans no list of all characters is made; with more the result is the same."""
    texts = ["\U0001f600 a@b.ru " * n + "\U0001f600" for n in (0, 1, 2, 31, 32, 33, 70)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    spans = F.transform(
        F.sequence(F.lit(1), F.size(F.split("text", "@")) - 1), lambda i: F.struct(((i - 1) * 9 + 2).alias("start"), ((i - 1) * 9 + 8).alias("end"))
    )
    spans = F.when(F.size(F.split("text", "@")) > 1, spans).otherwise(F.slice(spans, 1, 0))
    masked = rows.select("text", replace_spans(F.col("text"), spans, lambda s: F.lit("\u00d7")).alias("masked"))
    assert "substr" in _plan(masked.select("masked"))
    assert all(r.masked == r.text.replace("a@b.ru", "\u00d7") for r in masked.collect())


def test_text_that_holds_the_mark(spark):
    rows = spark.createDataFrame(
        [("￿a@b.ru￿￿ 10.0.0.1 \U0001f600 c@d.ru = e@f.ru",), ("a@b.ru 10.0.0.1",), ("￿",), ("",), (None,)], "text string"
    )
    found = findings(rows.withColumn("k", F.xxhash64("text")), Policy.only(SECRET, "email", "ip_address"), with_value=True)
    spans = {(r.start, r.end, r.value) for r in found.collect()}
    assert spans == {(1, 7, "a@b.ru"), (10, 18, "10.0.0.1"), (30, 36, "e@f.ru"), (0, 6, "a@b.ru"), (7, 15, "10.0.0.1")}
