"""Every knowledge query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from factloom.plans import catalog
from tests.conftest import SF
from tests.oracle import rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    assert got == sql_rows(catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
