"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from workload.oracle import ORACLES
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    same, note = compare(spark, db, name, FOLDER)
    assert same, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10
