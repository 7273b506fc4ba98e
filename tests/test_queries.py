"""Every query with SQL against DuckDB; every other one for rows and a stable schema."""

import pytest
from oracle import same

from vistaframe.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    first, again = QUERIES[name](spark, sf), QUERIES[name](spark, sf)
    assert first.schema == again.schema
    assert first.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
