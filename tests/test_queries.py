"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import by_duckdb, by_spark, connection

from plumbline.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert by_spark(QUERIES[name](spark, DATA)) == by_duckdb(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.collect()
