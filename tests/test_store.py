"""The versioned store of mappings and caches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import mapping
from cloakframe.sources import store as stores


def pairs(spark, rows):
    return spark.createDataFrame(rows, "digest string, token string")


def held(spark, path):
    return {r.digest: r.token for r in mapping.load_token_cache(spark, path).collect()}


def parts(spark, path):
    return mapping._cache_store(spark, path).state()["parts"]


def test_store_that_nobody_has_written(spark, tmp_path):
    path = str(tmp_path / "none")
    assert held(spark, path) == {}
    assert mapping.load_mapping(spark, path, "key").collect() == []
    mapping.compact_token_cache(spark, path)
    assert not os.path.exists(path)


def test_retried_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert mapping.save_token_cache(pairs(spark, [("a", "1")]), path, 0, "q", replace=False)
    before = parts(spark, path)
    assert not mapping.save_token_cache(pairs(spark, [("a", "2"), ("b", "2")]), path, 0, "q", replace=False)
    assert parts(spark, path) == before and held(spark, path) == {"a": "1"}
    assert mapping.save_token_cache(pairs(spark, [("c", "3")]), path, 0, "other", replace=False)
    assert mapping.save_token_cache(pairs(spark, [("a", "4")]), path, 0, "q")  # replaced, in its old place
    assert held(spark, path) == {"a": "4", "c": "3"}


def test_many_batches_leave_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 3)
    monkeypatch.setattr(stores, "KEPT", 4)
    path = str(tmp_path / "cache")
    for n in range(14):
        mapping.save_token_cache(pairs(spark, [("k", str(n)), (f"k{n}", "t")]).coalesce(1), path, n, "q", replace=False)
        if n == 4:
            assert mapping._cache_store(spark, path).rows().count() == 4 + 2 + 2
    assert held(spark, path) == {"k": "0"} | {f"k{n}": "t" for n in range(14)}
    state = mapping._cache_store(spark, path).state()
    assert len(state["parts"]) <= 6 and state["done"] == {"q": [[0, 13]]}
    assert len(os.listdir(f"{path}/_log")) <= 2 * 8 + 2  # with checksums
    live = {f"part={p['part']}" for p in state["parts"] + state["dropped"]}
    assert {n for n in os.listdir(path) if n.startswith("part=")} == live
    # A folded generation stays as it is.
    assert not mapping.save_token_cache(pairs(spark, [("k", "new")]), path, 0, "q")
    mapping.compact_token_cache(spark, path)
    assert len(parts(spark, path)) == 1 and held(spark, path)["k"] == "0"


def test_newest_value_survives_folding(spark, tmp_path):
    path = str(tmp_path / "mapping")
    rows = lambda v: spark.createDataFrame([("T_1", v), (f"T_{v}", v)], "token string, value string")
    for n, v in enumerate(("x", "y")):
        mapping.save_mapping(rows(v), path, "key", n)
    mapping.compact_mapping(spark, path)
    mapping.save_mapping(rows("z"), path, "key", 2)
    got = {r.token: r.value for r in mapping.load_mapping(spark, path, "key").collect()}
    assert got == {"T_1": "z", "T_x": "x", "T_y": "y", "T_z": "z"}
    with pytest.raises(Exception, match="(?i)aes|crypt|key"):
        mapping.load_mapping(spark, path, "wrong").select(F.max("value")).collect()


def test_two_writers_both_commit(spark, tmp_path):
    path = str(tmp_path / "cache")
    mapping.save_token_cache(pairs(spark, [("a", "1")]), path, 0)
    store = mapping._cache_store(spark, path)
    late = store.state()
    mapping.save_token_cache(pairs(spark, [("b", "2")]), path, 1)
    assert not store._publish(late)  # its number is taken; a commit reads the state again and goes on
    assert held(spark, path) == {"a": "1", "b": "2"}
    with open(f"{path}/_log/{2:020d}.json") as log:
        assert json.load(log)["version"] == 2
