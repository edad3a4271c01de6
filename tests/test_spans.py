"""Spans, overlap resolution and masked text on small cases and on random texts."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from cloakframe.functions import spans as span_functions
from cloakframe.functions.binding import running
from cloakframe.functions.patterns import DETECTOR_PRIORITIES, PATTERNS
from cloakframe.functions.spans import SPANS_TYPE, lost_spans, resolve_overlaps, span
from cloakframe.plans.extend import Extension, register_detector, register_masker
from cloakframe.plans.masking import analyze_text, findings, mask_with_stats
from cloakframe.plans.policy import Policy, Rule

POLICY = Policy.default("secret")


def spans_of(spark, texts, policy):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = findings(df, policy, keys=["id"], with_value=True).collect()
    out = [[] for _ in texts]
    for r in rows:
        out[r.id].append((r.detector, r.start, r.end, r.value, r.applied))
    return [sorted(o, key=lambda x: (x[1], x[0])) for o in out]


def masked(spark, texts, policy):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.text for r in mask_with_stats(df, policy).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("name", "text", "values"),
    [
        ("email", "Email: admin@example.com", ["admin@example.com"]),
        ("email", "a@b.co1x@y.com и иван@почта.рф, x.y+z@пример.рф", ["a@b.co", "1x@y.com", "x.y+z@пример.рф"]),
        ("phone", "Phone: +7 (999) 123-45-67", ["+7 (999) 123-45-67"]),
        ("phone", "Счет 40802810538320000272", []),
        ("phone", "8---123---45--67 89991234567 8(999)1234567", ["89991234567", "8(999)1234567"]),
        ("bank_account", "Счет 40802810538320000272", ["40802810538320000272"]),
        ("bank_account", "140802810538320000272", []),
        ("bik", "БИК 046577964", ["046577964"]),
        ("document_code", "Код=ЗК2603ИП260208340004", ["ЗК2603ИП260208340004"]),
        ("document_code", "Договор №ABCORG0006 от 01.02.2026", ["ABCORG0006"]),
        ("document_code", "Код=046577964 ИНН=7707083893 Счет=40802810538320000272", []),
        ("document_code", "id\n A1-----, valid A12345, doc: A12345", ["A12345"]),
        ("inn", "7707083893 500100732259 7707083894", ["7707083893", "500100732259"]),
        ("guid", "x550e8400-e29b-41d4-a716-446655440000", ["550e8400-e29b-41d4-a716-446655440000"]),
        ("kpp", "773401001 7734AB001 77341A0012", ["773401001", "7734AB001"]),
        ("ogrn", "1027700132195 304500116000157 1027700132196", ["1027700132195", "304500116000157"]),
        ("snils", "112-233-445 95, 11223344595 и 112-233-445 96", ["112-233-445 95", "11223344595"]),
        ("ip_address", "10.0.0.1, 256.1.1.1 1.2.3.4.5 10.0.0.1. (8.8.8.8)", ["10.0.0.1", "8.8.8.8"]),
        ("url", "http://пример.рф/a?b=1, ftp://u:p@1.2.3.4:21/x) https://nodots", ["http://пример.рф/a?b=1,", "ftp://u:p@1.2.3.4:21/x"]),
        ("ipv6", "::1 fe80::1 12:34:56x", ["::1", "fe80::1"]),
        ("inn", "٧٧٠٧٠٨٣٨٩٣", ["٧٧٠٧٠٨٣٨٩٣"]),
    ],
)
def test_detector(spark, name, text, values):
    found = spans_of(spark, [text], Policy.only("secret", name))[0]
    assert [f[3] for f in found] == values
    assert all(text[s:e] == v for _, s, e, v, _ in found)


def test_key_positions(spark):
    texts = ["046577964=1", "046577964   =1", "046577964    =1", "046577964 и итого = 42", "a= 046577964"]
    assert [len(s) for s in spans_of(spark, texts, Policy.only("secret", "bik"))] == [0, 0, 1, 1, 1]


def test_statement_lines(spark):
    text = "\n".join(
        [
            "РасчСчет=40802810538320000272",
            "БИК=046577964",
            "ИНН=7707083893",
            "Телефон=+7 (999) 123-45-67",
            "Почта=admin@example.com",
            "Код=ЗК2603ИП260208340004",
        ]
    )
    policy = Policy("secret", rules={n: Rule(mode="redact") for n in POLICY.rules})
    assert masked(spark, [text], policy)[0].split("\n") == [
        "РасчСчет=BANK_ACCOUNT_REDACTED",
        "БИК=BIK_REDACTED",
        "ИНН=INN_REDACTED",
        "Телефон=PHONE_REDACTED",
        "Почта=EMAIL_REDACTED",
        "Код=DOCUMENT_CODE_REDACTED",
    ]


def test_statistics_add_up(spark):
    df = spark.createDataFrame([(1, "БИК 046577964, a@b.ru"), (2, None), (3, "")], "id int, text string")
    rows = {r.id: r for r in analyze_text(df, POLICY).collect()}
    assert (rows[1].matches_found, rows[1].matches_applied, rows[1].matches_skipped) == (3, 2, 1)
    assert rows[1].detector_counts == {"bik": 1, "email": 1}
    assert rows[2].matches_found == rows[3].matches_found == 0
    assert [r.text for r in mask_with_stats(df, POLICY).orderBy("id").collect()][1:] == [None, ""]


def test_span_without_rule_stays_but_counts(spark):
    df = spark.createDataFrame([(1, "see DOC-1 now")], "id int, text string").withColumn(
        "entities",
        F.array(span(F.lit(4), F.lit(9), F.lit("document"), F.lit(10), F.lit(0), F.lit("DOC-1"))),
    )
    row = mask_with_stats(df, POLICY, extra="entities").first()
    assert row.text == "see DOC-1 now" and row.matches_applied == 1 and row.detector_counts == {"document": 1}


@pytest.mark.parametrize("chain, sweep", [(128, 64), (2, 64), (1, 2)])
def test_resolution_is_greedy_by_rank(spark, monkeypatch, chain, sweep):
    """Random spans against a direct statement of the rule, also where chains are resolved class by class."""
    monkeypatch.setattr(span_functions, "_CHAIN", chain)
    monkeypatch.setattr(span_functions, "_SWEEP", sweep)
    rng = random.Random(7)
    cases = []
    for i in range(300):
        spans = []
        for o in range(rng.randint(0, 12)):
            start = rng.randint(0, 40)
            spans.append((start, start + rng.randint(1, 9), f"d{o}", rng.choice([10, 75, 80]), o, "v"))
        cases.append((i, spans))
    kind = "array<struct<start:int,end:int,detector:string,priority:int,ord:int,value:string>>"
    df = spark.createDataFrame(cases, f"id int, spans {kind}")
    got = {r.id: [tuple(s) for s in r.kept] for r in df.select("id", resolve_overlaps(F.col("spans")).alias("kept")).collect()}
    for i, spans in cases:
        kept = []
        for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], s[4])):
            if all(s[0] >= k[1] or k[0] >= s[1] for k in kept):
                kept.append(s)
        assert got[i] == sorted(kept)


def test_a_long_chain_of_touching_spans(spark):
    """Every span overlaps its neighbours, of two kinds and three lengths: no list grows with the chain at each step."""
    kind = "struct<start:int,end:int,detector:string,priority:int,ord:int,value:string>"
    chain = F.expr(f"transform(sequence(0, 39999), i -> cast(struct(i * 4, i * 4 + 5 + i % 3, 'd', if(i % 7 = 0, 80, 75), 1, 'v') as {kind}))")
    started = time.perf_counter()
    kept = spark.range(1).select(resolve_overlaps(chain).alias("kept")).first().kept
    assert time.perf_counter() - started < 60
    spans = [(i * 4, i * 4 + 5 + i % 3, 80 if i % 7 == 0 else 75) for i in range(40_000)]
    want, taken = [], set()
    for start, end, _ in sorted(spans, key=lambda s: (-s[2], s[0] - s[1], s[0])):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            want.append((start, end))
    assert [(s.start, s.end) for s in kept] == sorted(want)


LABEL = r"[a-zA-Z0-9\p{L}](?:[a-zA-Z0-9\p{L}\-]*[a-zA-Z0-9\p{L}])?"
BACKTRACKING = {
    "email": r"[a-zA-Z0-9._%+\-]+@(?:[a-zA-Z0-9\p{L}][a-zA-Z0-9\p{L}\-]*\.)+[a-zA-Z\p{L}]{2,}",
    "url": (
        r"(?:https?|ftps?)://(?:[a-zA-Z0-9._~%+\-]+(?::[a-zA-Z0-9._~%+\-]*)?@)?"
        rf"(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}|{LABEL}(?:\.{LABEL})+)"
        r"""(?::\d{1,5})?(?:/[^\s<>"')\]]*)?"""
    ),
}


def test_random_texts_against_scanning(spark):
    """Detection on random texts against a scan with another regular-expression engine."""
    rng = random.Random(11)
    bits = [
        "046577964", "7707083893", "+7 (999) 123-45-67", "89991234567", "a.b@c.de", "@", "1.2.3.4", ".", "=", " ", "  ",
        "\n", "-", "№", "код", "id", "doc", ":", "AB12", "http://", "x.ru/p", "40802810538320000272", "112-233-445 95",
        "7734AB001", "ё", "😀", "550e8400-e29b-41d4-a716-446655440000", "1027700132195", "/", "#", "9", "0",
        "b.c", "u:p@", "--", "q", "рф", "https://", "x@", "d.1", "ab.", ".z.", "a-b",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    found = spans_of(spark, texts, POLICY)
    checks = {"inn": valid_inn, "ogrn": valid_ogrn, "snils": valid_snils}
    for text, got in zip(texts, found, strict=True):
        want = []
        for name in DETECTOR_PRIORITIES:
            pattern = BACKTRACKING.get(name, PATTERNS[name]).replace("(?U)", "").replace("(?Ui)", "(?i)")
            group = 1 if name == "document_code" else 0
            for hit in regex.finditer(pattern, text):
                start, end = hit.span(group)
                value = text[start:end]
                if name in checks and not checks[name](value):
                    continue
                if not regex.match(" *=", text[end : end + 4]):
                    want.append((name, start, end, value))
        assert sorted(g[:4] for g in got) == sorted(want), text


def valid_inn(v):
    d = [int(c) for c in v]
    if len(d) == 10:
        return sum(a * b for a, b in zip(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10 == d[9]
    first = sum(a * b for a, b in zip(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    second = sum(a * b for a, b in zip(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    return (first, second) == (d[10], d[11])


def valid_ogrn(v):
    return int(v[:-1]) % (len(v) - 2) % 10 == int(v[-1])


def valid_snils(v):
    d = [int(c) for c in v if c.isdigit()]
    return d[:2] != [0, 0] and sum(x * (9 - i) for i, x in enumerate(d[:9])) % 101 % 100 == d[9] * 10 + d[10]


def test_long_inputs_stay_linear(spark):
    """Runs that make backtracking patterns explode are scanned in reasonable time."""
    texts = [
        "x@aa" + ".1" * 50_000, "http://a" + ".b" * 50_000, "x@" + "b-" * 50_000 + ".ru",
        "a" * 300_000 + "@", "#" + " " * 200_000 + "x1", "1" * 300_000, "x" * 100_000 + "@" + "y." * 2_000, "-" * 200_000,
    ]
    assert [len(s) for s in spans_of(spark, texts, POLICY)] == [0, 1, 1, 0, 0, 0, 0, 0]


def test_user_detectors(spark):
    policy = register_detector(POLICY, "ticket", r"T-\d+", rule=Rule(prefix="TICKET"))
    assert masked(spark, ["see T-12"], policy)[0].startswith("see TICKET_")

    @F.pandas_udf("array<struct<start:int,end:int,value:string>>")
    def shout(texts):
        import re

        return texts.map(
            lambda t: [{"start": m.start(), "end": m.end(), "value": m.group()} for m in re.finditer("[A-Z]{4,}", t)]
        )

    policy = register_detector(Policy("secret"), "shout", spans=shout, rule=Rule(mode="redact"))
    assert masked(spark, ["a LOUD b", "x"], policy) == ["a SHOUT_REDACTED b", "x"]
    policy = register_masker(policy, "shout", F.lower)
    assert masked(spark, ["a LOUD b"], policy) == ["a loud b"]


def test_extension_checks():
    from cloakframe.functions.patterns import Detector

    registry = POLICY.registry
    for bad in (
        Extension("", Detector("")),
        Extension("a", Detector("b")),
        Extension("email", Detector("email")),
        Extension("a", Detector("a"), version="1"),
        Extension("a", Detector("a"), version="1", title="t", capabilities=["network"]),
    ):
        with pytest.raises(ValueError):
            registry.with_extension(bad)
    with pytest.raises(ValueError):
        registry.get("none")
    with pytest.raises(ValueError):
        register_detector(POLICY, "x")
    with pytest.raises(ValueError):
        register_masker(POLICY, "x", F.lower)


def test_texts_of_very_many_spans(spark):
    """Span lists are built without growing them, so the costs of a text stay near its size."""
    policy = Policy.only("secret", "email")

    def seconds(n):
        df = spark.range(1).select(F.expr(f"repeat('to ab@mail.ru and ', cast(id as int) + {n})").alias("text"))
        started = time.perf_counter()
        assert mask_with_stats(df, policy).first().matches_applied == n
        return time.perf_counter() - started

    seconds(100)
    assert seconds(100_000) < 20 * max(seconds(10_000), 1)


def test_running_folds_across_blocks(spark):
    for n in (0, 1, 63, 64, 65, 200):
        numbers = F.expr(f"transform(sequence(1, {n + 1}), x -> int(x))")
        row = spark.range(1).select(running(F.slice(numbers, 1, n), lambda a, b: a + b, 0).alias("r")).first()
        assert row.r == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_groups_of_touching_spans(spark):
    spans = [(10 * i + j, 10 * i + j + 5, "d", j, 1, "v") for i in range(100) for j in (0, 3)]
    df = spark.createDataFrame([(spans,)], f"s {SPANS_TYPE}")
    kept = df.select(resolve_overlaps(F.col("s")).alias("k"), lost_spans(F.col("s"), resolve_overlaps(F.col("s"))).alias("l")).first()
    assert [s.start for s in kept.k] == [10 * i + 3 for i in range(100)]
    assert [s.start for s in kept.l] == [10 * i for i in range(100)]
