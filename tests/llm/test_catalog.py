"""Queries that SQL can express against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
from feedfold.llm import catalog
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(name, spark):
    good, note = compare(spark, duck(SF), SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert good, note


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in catalog.QUERIES}
    assert numbers == set(range(1, 14)) and len(catalog.QUERIES) == 13
    assert set(catalog.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
