"""Every query with SQL gives the SQL's rows; the others give some rows. Runs on the smallest tables."""

import importlib.util
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check_oracle.py")
_spec = importlib.util.spec_from_file_location("check_oracle", _path)
check_oracle = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check_oracle)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    ok, text = check_oracle.compare(spark, duck, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
