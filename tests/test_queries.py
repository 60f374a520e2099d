"""Every registered query against its SQL."""

import pytest

from oracle import duck, spark_rows
from tallymill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    assert spark_rows(registry.QUERIES[name](spark, data)) == duck(registry.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_and_contract(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
