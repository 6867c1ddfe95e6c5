"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, sf, name):
    result = compare(spark, connection, name, sf)
    assert result.startswith(("ok", "rows only")), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
