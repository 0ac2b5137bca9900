import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from vulnspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression over one row of text columns."""

    def run(expression, schema=None, **columns):
        names = list(columns)
        ddl = schema or ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(columns.values())], ddl)
        return df.select(expression.alias("v")).first()["v"]

    return run
