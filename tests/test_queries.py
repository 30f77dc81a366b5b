"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from scholia import registry
from tests.conftest import SF, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, expected = rows_of_sql(duck, SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
