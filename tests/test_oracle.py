"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entries
from rillcask import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
catalog.load()
SQL = catalog.SQL


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = compare(spark, db, FOLDER, catalog.QUERIES[name], SQL.get(name))
    assert got["match"] is True, got


def test_entry_has_rows(spark):
    assert entries.entry(spark).count() > 0
