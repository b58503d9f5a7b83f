import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kinpanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, **{
        "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, [tuple, ...]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)


@pytest.fixture
def listed():
    """Sorted tuples of a DataFrame, optionally of some columns."""
    def collect(df, *columns):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))
    return collect
