import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedfold.session import local_session  # noqa: E402
from checks import catalog  # noqa: E402,F401  (sends the package's functions by value)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a DDL schema as a DataFrame."""
    def make(schema, *data):
        return spark.createDataFrame([tuple(d) for d in data], schema)
    return make


@pytest.fixture
def value(spark):
    """One expression over one row of text columns."""
    def evaluate(expression, **columns):
        names = list(columns) or ["_"]
        schema = ", ".join(f"`{n}` string" for n in names)
        data = [tuple(columns.get(n) for n in names)]
        return spark.createDataFrame(data, schema).select(expression.alias("v")).first()[0]
    return evaluate
