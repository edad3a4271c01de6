"""Every registered query against its SQL, over tables of three part files, as a cluster writes them."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Those of the training-data subpackage have their own tests.
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The tables as folders of part files. The SQL reads the given single files."""
    folder = str(tmp_path_factory.mktemp("parted"))
    for name in os.listdir(SF_DIR):
        spark.read.parquet(f"{SF_DIR}/{name}").repartition(3).write.parquet(f"{folder}/{name}")
    return folder


#: Those that read streams or stores over single files too, which Spark's readers treat differently.
SINGLE = ("mask_stream", "mapping_stream", "mapping_stream_onto_store", "token_cache_stream", "mask_documents")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, parted, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], parted) is None


@pytest.mark.parametrize("name", SINGLE)
def test_query_over_single_files(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
