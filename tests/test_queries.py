"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_queries_have_sql():
    assert set(entry.ORACLE) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "source_url", "title", "text_length", "content_hash", "extractor", "processing_state"]
    assert df.count() > 0
