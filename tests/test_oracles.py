"""Every registered query against its DuckDB oracle (the driver's check), at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, con, name):
    got = QUERIES[name](spark, sf_small).toPandas()
    exp = con.execute(ORACLES[name]).df()
    assert compare(got, exp) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "wpm" in df.columns
