"""Entity candidates against a direct statement of the rules on random input."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.labels import normalize_entity_type
from cloakframe.operators import ner

SCHEMA = (
    "doc_id int, entity_type string, start int, end int, value string, source string, confidence double, priority int"
)


def resolve_one(rows):
    """Groups of overlapping candidates in order, and the winner of each."""
    rows = sorted(rows, key=lambda r: (r["start"], r["end"]))
    groups, reach = [], None
    for r in rows:
        if reach is not None and r["start"] < reach:
            groups[-1].append(r)
            reach = max(reach, r["end"])
        else:
            groups.append([r])
            reach = r["end"]
    rank = lambda r: (-r["priority"], -(r["confidence"] or 0.0), r["start"] - r["end"], r["start"])
    out = []
    for group in groups:
        kinds = list(dict.fromkeys(r["entity_type"] for r in group))
        best = min((min((r for r in group if r["entity_type"] == k), key=rank) for k in kinds), key=rank)
        same = [r for r in group if r["entity_type"] == best["entity_type"]]
        known = [r["confidence"] for r in same if r["confidence"] is not None]
        out.append(
            (best["entity_type"], best["start"], best["end"], sorted({r["source"] for r in same}), max(known, default=None))
        )
    return out


@pytest.mark.parametrize("block", [4, 65_536])
def test_resolver(spark, monkeypatch, block):
    """Small blocks make most groups cross block borders."""
    monkeypatch.setattr(ner, "BLOCK_CHARS", block)
    rng = random.Random(block)
    names = ["spacy", "natasha", "qwen", "gliner"]
    rows = []
    for doc in range(60):
        for source in names:
            for _ in range(rng.randint(0, 5)):
                start = rng.randint(0, 60)
                end = start + rng.randint(1, 12)
                conf = rng.choice([None, 0.2, 0.5, 0.5, 0.9])
                rows.append((doc, rng.choice("abc"), start, end, f"{start}-{end}", source, conf, rng.choice([10, 20])))
    df = spark.createDataFrame(rows, SCHEMA)
    united = ner.ner_union(*[df.where(F.col("source") == n) for n in names])
    got = {}
    for r in ner.ner_resolve(united, min_confidence=0.3).collect():
        got.setdefault(r.doc_id, []).append((r.entity_type, r.start, r.end, r.sources, r.confidence))
    fields = [c.split()[0] for c in SCHEMA.split(", ")]
    for doc in range(60):
        mine = [dict(zip(fields, r)) for r in sorted(rows, key=lambda r: names.index(r[5])) if r[0] == doc]
        want = resolve_one([r for r in mine if r["confidence"] is None or r["confidence"] >= 0.3])
        assert sorted(got.get(doc, []), key=lambda x: x[1]) == want


def test_safe_spans(spark):
    text = "Иван-x Петров_ A=b\nC"
    spans = [(0, 4, True), (0, 3, False), (7, 13, False), (5, 6, True), (15, 18, False), (17, 20, False), (3, 3, False), (19, 40, False)]
    df = spark.createDataFrame([(s, e, text[s:e], text, ok) for s, e, ok in spans], "s int, e int, v string, t string, ok boolean")
    rows = df.select("ok", ner.ner_safe_span(F.col("t"), F.col("s"), F.col("e"), F.col("v")).alias("got")).collect()
    assert [r.got for r in rows] == [r.ok for r in rows]


def test_labels(spark):
    labels = ["full name", "PER", " legal-entity ", "gpe", "Odd Label", "bank account"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, v string")
    got = [r.o for r in df.select("i", normalize_entity_type(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == ["person", "person", "organization", "location", "odd_label", "bank_account"]


def test_answers_without_a_list(spark):
    answers = ["", "no list", "[1, 2", "[[]]", 'x [a] [{"label":"PER","start":0,"end":2,"confidence":0.9}]', None]
    df = spark.createDataFrame([(i, a, "abcdef") for i, a in enumerate(answers)], "doc_id int, answer string, text string")
    rows = ner.ner_parse_json(df).collect()
    assert [(r.doc_id, r.value, r.entity_type) for r in rows] == [(4, "ab", "person")]


def test_bounds():
    with pytest.raises(ValueError):
        ner.ner_filter_confidence(None, 1.5)
