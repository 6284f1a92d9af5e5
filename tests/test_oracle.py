"""Every registered query against its DuckDB oracle on the smallest tables,
exact value match (canonical repr, order-insensitive)."""

import pytest

import __spark_entry__ as E
from zonestats.plans import catalog
from oracle_check import compare

from conftest import SF_SMALL

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["status"] == "exact", r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["dept_name", "active_energy"]
    assert len(rows) == 5
    vals = [r["active_energy"] for r in rows]
    assert vals == sorted(vals, reverse=True)
