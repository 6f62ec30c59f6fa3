"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import DATA

from tessera.plans.reference import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_agrees_with_sql(name, agree):
    assert agree(REGISTRY.queries[name], REGISTRY.sql[name]) > 0


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_runs_without_sql(name, spark):
    assert REGISTRY.queries[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(REGISTRY.queries) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 3
