"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check_queries import compare, connection

import __spark_entry__ as entry

CHECKED = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query(name, spark, con, folder):
    verdict = compare(name, spark, con, folder)
    assert verdict.startswith(("ok", "rows")), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 15
