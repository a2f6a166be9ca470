"""Registered corpus queries: SQL where there is some, sizes and columns of the others."""

import pytest
from oracle import by_duckdb, by_spark, connection

from plumbline.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert by_spark(QUERIES[name](spark, DATA)) == by_duckdb(connection(DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_covers_the_table(spark, name):
    df = QUERIES[name](spark, DATA)
    key, of = ("doc_id", "documents")
    whole = {r[0] for r in spark.read.parquet(f"{DATA}/{of}.parquet").select(key).collect()}
    assert {r[0] for r in df.select(key).collect()} == whole
