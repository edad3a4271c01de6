"""What grows with the rows stays where it is, moves once, or is gone through once."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.patterns import BUILTIN_DETECTORS
from cloakframe.functions.spans import collect_spans
from cloakframe.operators import ner
from cloakframe.plans.policy import Policy
from cloakframe.sources import blocks
from cloakframe.sources.readers import dealt


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_texts_of_blocks_are_not_moved(spark, tmp_path):
    """Only one row per range goes through an exchange; the blocks do not."""
    (tmp_path / "a.txt").write_text("user a@mail.ru\n" * 50)
    plan = _plan(blocks.mask_text_blocks(blocks.read_text_blocks(spark, str(tmp_path)), Policy.default("s")))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_many_small_files_are_not_broadcast(spark, tmp_path):
    """A file of one range has no border that another task has to know."""
    for i in range(20):
        (tmp_path / f"{i}.txt").write_text(f"file {i}\n" * 3 + "end" * (i % 2))
    read = blocks.read_text_blocks(spark, str(tmp_path)).select("source", "before", "text", "after").collect()
    assert sorted(r.text for r in read) == sorted(f"file {i}\n" * 3 + "end" * (i % 2) for i in range(20))
    assert all(r.before == r.after == "" for r in read)


def test_small_blocks_leave_together():
    import pyarrow as pa

    words = [f"w{i}" for i in range(5000)]
    n = len(words)
    columns = [["f"] * n, [0] * n, [9] * n, [True] * n, words, [len(w) for w in words]]
    names = ["source", "split", "size", "alone", "value", "n_bytes"]
    made = list(blocks._blocks(iter([pa.RecordBatch.from_pydict(dict(zip(names, columns)))]), " ", 200, 20))
    rows = [r for b in made for r in b.to_pylist()]
    assert len(made) < 5 and len(rows) > 100
    assert "".join(r["text"] for r in rows) == "".join(w + " " for w in words)
    assert rows[-1]["last"] and rows[-1]["n_bytes"] == sum(len(w) + 1 for w in words)


@pytest.mark.parametrize("small", [True, False])
def test_ends_of_ranges(small):
    """Heads and tails of ranges are those of their records put together, whatever the records' lengths."""
    import pyarrow as pa

    rnd, halo = random.Random(small), 7
    ranges = [["é" * rnd.randint(0, 4 if small else 30) for _ in range(rnd.randint(1, 60))] for _ in range(30)]
    rows = [("f", i, v[:halo], v[-halo:] if len(v) > halo else None, len(v.encode())) for i, vs in enumerate(ranges) for v in vs]
    batches = [pa.RecordBatch.from_pydict(dict(zip("abcde", zip(*rows[i : i + 11])))) for i in range(0, len(rows), 11)]
    got = [r for b in blocks._ends(iter(batches), "; ", halo) for r in b.to_pylist()]
    for r, vs in zip(got, ranges, strict=True):
        whole = "".join(v + "; " for v in vs)
        assert (r["head"], r["tail"], r["n_bytes"]) == (whole[:halo], whole[-halo:], len(whole.encode()))


_SAMPLES = {
    "email": [*"ab1.-_%+@@@é =Я", "@mail.ru", "a@b.ru"],
    "phone": [*"+78 ()-1٣5", "999", "123", "45"],
    "document_code": [*"#№:= .-_/aЯ1٣", "id", "İd", "ıd", "код", "КОД", "doc", "номер", "ABC0123", "X1Y2Z3"],
    "url": [*"htfps:/.@a1é ", "http://", "ftp://", "a.ru", "10.0.0.1"],
    "ip_address": [*"0125.. a٣", "10.0.0.1", "256."],
}


@pytest.mark.parametrize("name", [n for n, d in BUILTIN_DETECTORS.items() if n not in ("guid", "ipv6")])
def test_scans_find_what_patterns_find(spark, name):
    rnd, detector = random.Random(len(name)), BUILTIN_DETECTORS[name]
    parts = _SAMPLES.get(name, [*"0123456789٣ -A", "12345", "000", "7707083893"])
    texts = [("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))),) for _ in range(3000)]
    was = F.regexp_replace("t", F.lit(detector.pattern), F.lit("<$0>"))
    now = F.regexp_replace("t", F.lit(detector.scan), F.lit("${gap}<${match}>"))
    rows = spark.createDataFrame(texts, "t string").select("t", was.alias("was"), now.alias("now")).collect()
    assert all(r.was == r.now for r in rows) and any(r.was != r.t for r in rows)


def test_scans_of_long_texts(spark):
    """A text of many places at which no match begins is gone through without recursion."""
    text = "a b@ 1.2.3 +8 h:// id № 12345 " * 60_000 + " a@mail.ru 10.0.0.1 id=AB1234"
    rows = spark.createDataFrame([(text,)], "t string")
    found = rows.select(F.explode(collect_spans(F.col("t"), Policy.default("s").detectors())).alias("s")).select("s.*").collect()
    assert {r.value for r in found} >= {"a@mail.ru", "10.0.0.1", "AB1234"}


_CANDIDATES = (
    "doc_id int, entity_type string, start int, end int, value string, source string, confidence double, priority int, seq int"
)


def _candidates(spark, seed: int):
    """Two texts and a null key, long spans, and rows that come twice."""
    rnd, rows = random.Random(seed), []
    for _ in range(250):
        start = rnd.randint(0, 900)
        end = start + rnd.choice([1, 2, 3, 5, 40])
        conf = rnd.choice([None, 0.4, 0.9])
        rows.append((rnd.choice([1, 2, None]), rnd.choice("ab"), start, end, f"{start}-{end}", rnd.choice("xyz"), conf, rnd.choice([1, 2]), 0))
    return spark.createDataFrame(rows + rows[:60], _CANDIDATES)


def test_candidates_are_shuffled_once(spark):
    """By key and block; after that only what crosses a border of blocks."""
    plan = _plan(ner.ner_resolve(_candidates(spark, 1)))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("doc_id" in line for line in exchanges)
    assert sum("cluster#" in line for line in exchanges) == 2  # by type and by group, of groups that cross a border


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block", [3, 16, 100])
def test_groups_across_blocks(spark, monkeypatch, block, seed):
    rows = _candidates(spark, seed)

    def found():
        best = ner.ner_resolve(rows, min_confidence=0.3).collect()
        return sorted(map(str, best)), sorted(map(str, ner.ner_cluster(rows).collect()))

    whole = found()
    assert len(whole[1]) == 310
    monkeypatch.setattr(ner, "BLOCK_CHARS", block)
    assert found() == whole


def test_a_file_of_many_row_groups_is_not_dealt(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(40_000).selectExpr("id", "uuid() AS u").coalesce(1).write.option("parquet.block.size", 20_000).parquet(path)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = dealt(spark.read.parquet(path))
        assert "RoundRobin" not in _plan(rows) and rows.count() == 40_000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
