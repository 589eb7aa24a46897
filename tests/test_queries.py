"""Every registered query against its SQL, on the whole tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import difference
from tests.conftest import DATA, field_queries

ORACLE = contract.oracle_sql()


def test_every_query_has_sql():
    assert set(field_queries()) <= set(ORACLE)


@pytest.mark.parametrize("name", field_queries())
def test_query_equals_sql(name, spark, connection):
    assert difference(contract.queries()[name](spark, DATA), connection, ORACLE[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
