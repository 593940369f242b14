"""Every registered query on the smallest supplied tables against its SQL on DuckDB."""

import pytest
from oracle import compare, connect

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES, SQL, SF)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
