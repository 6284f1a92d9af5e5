"""The operators that SQL can express, against their SQL."""

import pytest

from oracle_check import compare
from zonestats.llm import queries

from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, queries.QUERIES[name], queries.ORACLES[name], SF_SMALL)
    assert r["status"] == "exact", r
