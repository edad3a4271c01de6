"""The first JSON array in a model's answer, against trying every pair of brackets."""

import json
import random
import time

from pyspark.sql import functions as F

from cloakframe.operators.ner import _first_json_array


def plain(answer):
    for start in [i for i, c in enumerate(answer) if c == "["]:
        for stop in [i for i in range(len(answer) - 1, start, -1) if answer[i] == "]"]:
            try:
                found = json.loads(answer[start : stop + 1])
            except ValueError:
                continue
            if isinstance(found, list):
                return found
    return None


def first_arrays(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    rows = df.select("id", F.to_json(_first_json_array(F.col("answer"))).alias("found")).collect()
    return {r.id: None if r.found is None else json.loads(r.found) for r in rows}


def test_arrays_by_plain_search(spark):
    rnd = random.Random(9)
    pieces = ['[', ']', '[', ']', '"', '\\"', '\\\\', '{"a":1}', '{', ',', '1', ' ', 'x', '"b]"', '"[c"', '[]', 'é', ':']
    answers = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    answers += ['say "x [1]', '[["a", "]"], 2] [3]', 'it\'s \\[1] no', '["\\"]"]', '["\\\\"]', "", '[[[[ x ]]]] [7]']
    got = first_arrays(spark, answers)
    assert {i: plain(a) for i, a in enumerate(answers)} == got
    assert sum(v is not None for v in got.values()) > 100


def test_many_brackets(spark):
    answers = ["[" * 20_000, "[x]" * 10_000 + "[1]", "[" * 10_000 + "]" * 9_000 + "[", ("[" * 5 + "x" + "]" * 5) * 2000 + '["a"]']
    first_arrays(spark, answers[:1])
    started = time.perf_counter()
    got = first_arrays(spark, answers)
    assert got[1] == [1] and got[3] == ["a"] and got[0] is None
    assert time.perf_counter() - started < 30
