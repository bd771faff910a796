"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.run import compare, connect

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, con, sf, name):
    assert not compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf).startswith("FAIL")


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "tier_1", "tier_2", "tier_3"]


def test_files_of_a_round_take_the_place_of_earlier_ones(spark, tmp_path, monkeypatch):
    import checks.queries as module

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(module, "LEAST_FILES", documents // 4, raising=False)
    assert module.QUERIES["read_utf8_files"](spark, sf).select("doc_id").distinct().count() == documents
    assert 0 < len(list(tmp_path.glob("files/**/*.txt"))) < documents / 2


def test_files_of_a_round_are_a_file_each_in_few_folders(spark, tmp_path, monkeypatch):
    import checks.queries as module

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(module, "LEAST_FILES", documents)  # one round
    assert module.QUERIES["read_utf8_files"](spark, sf).count() == documents
    lies = list(tmp_path.glob("files/**/*"))
    assert sum(x.is_file() for x in lies) == documents  # no checksums beside them
    assert sum(x.is_dir() for x in lies) <= 64  # no folder for each
