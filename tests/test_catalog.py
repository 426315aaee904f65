"""Every query against its SQL, and the rest against brute force on small fixtures."""

import pytest

from ledgerlight import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
