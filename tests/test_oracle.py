"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names and an order-insensitive value hash)."""

import pytest

import __spark_entry__ as entry_module
from conftest import SF_SMALL
from oracle_check import compare, duck

# (the corpus operators have tests of their own, beside them)
QUERIES = {k: v for k, v in entry_module.queries().items() if k not in entry_module.CORPUS_QUERIES}
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k not in entry_module.CORPUS_ORACLE}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "total_cost" in df.columns
