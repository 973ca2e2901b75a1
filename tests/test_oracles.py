"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from checks import catalog
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, con):
    good, note = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert good, note


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
