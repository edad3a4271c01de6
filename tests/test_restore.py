"""Restoring with keys of any shape."""

import random
import re

from pyspark.sql import functions as F

from cloakframe.operators import restore


def plain(text, known):
    if not known:
        return text, 0
    pattern = re.compile("|".join(re.escape(k) for k in sorted(known, key=len, reverse=True)))
    return pattern.subn(lambda m: known[m[0]], text)


def keys_and_texts(rnd, n):
    letter = lambda: rnd.choice("ab\u0436 #\U0001f600(")
    known = {"".join(letter() for _ in range(rnd.choice((1, 2, 3, 4, 5, 7, 8, 9, 20)))): f"<{i}>" for i in range(n)}
    texts = ["".join(rnd.choice([letter(), letter(), rnd.choice(list(known))]) for _ in range(rnd.choice((0, 1, 5, 60)))) for _ in range(60)]
    return known, texts


def test_places_of_keys_at_chunk_borders(monkeypatch):
    rnd = random.Random(1)
    import numpy as np

    for chunk in (1, 3, 1 << 18):
        monkeypatch.setattr(restore, "CHUNK", chunk)
        known, texts = keys_and_texts(rnd, 12)
        yes = np.ones(1 << restore.BITS, bool)
        lengths = {}
        for n in {len(k) for k in known}:
            lengths.setdefault(restore._head(n), []).append(n)
        for text in texts:
            hits = [(p, text[p : p + n], known[text[p : p + n]]) for p, n in restore.key_places(text, yes, yes, lengths) if text[p : p + n] in known]
            spans = restore.leftmost_longest(hits)
            out, at = "", 0
            for start, end, value in spans:
                out, at = out + text[at:start] + value, end
            assert (out + text[at:], len(spans)) == plain(text, known)


def test_restoring_by_plain_version(spark):
    rnd = random.Random(2)
    for n in (1, 30):
        known, texts = keys_and_texts(rnd, n)
        rows = [(i, t, "x") for i, t in enumerate([*texts, texts[5], None, ""])]
        df = spark.createDataFrame(rows, "id long, text string, token string")
        mapping = spark.createDataFrame([*known.items(), ("", "no"), (None, "no"), ("ab", None)], "token string, value string")
        got = {r.id: (r.text, r.replacements, r.token) for r in restore.demask_any_keys(df, mapping).collect()}
        assert got == {i: (*plain(t, known), "x") if t is not None else (None, 0, "x") for i, t, _ in rows}
    assert restore.demask_any_keys(df, mapping.limit(0)).where("replacements > 0").count() == 0
    assert restore.demask_any_keys(df.limit(0), mapping).count() == 0


def test_many_keys(spark):
    """More keys than any pattern or literal holds; one text holds a third of all places."""
    mapping = spark.range(200_000).select(F.concat(F.lit("key "), F.hex("id"), F.lit("!")).alias("token"), F.col("id").cast("string").alias("value"))
    texts = spark.range(200).select("id", F.expr("concat('of key ', hex(id * 997), '! and key ', hex(id + 500000), '! end')").alias("text"))
    texts = texts.unionByName(spark.range(100).select("id", F.lit("key 1!key 2! key 1").alias("text")))
    rows = restore.demask_any_keys(texts, mapping).collect()
    assert sum(r.replacements for r in rows) == 200 + 200
    assert {r.text for r in rows if not r.text.startswith("of")} == {"12 key 1"}
    assert "of 997 and key 7A121! end" in {r.text for r in rows}
