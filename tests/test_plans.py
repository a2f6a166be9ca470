"""Plan-level analysis of small programs against the types that are expected of them."""

import duckdb
import pytest
from oracle import by_duckdb, by_spark

from plumbline.queries import library  # noqa: F401 - adds a case
from plumbline.queries.calls import CASES, EXPECTED


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    assert by_spark(CASES[name](spark, "")) == by_duckdb(duckdb.connect(), EXPECTED[name])
