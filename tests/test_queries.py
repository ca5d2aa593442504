"""Every registered query against its SQL; queries without SQL must return rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, connect  # noqa: E402

from barloom.plans.catalog import load  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(load()))
def test_query(name, spark, sf, con):
    entry = load()[name]
    problems, rows, _, _ = compare(entry.run(spark, sf), con, entry.sql)
    assert not problems, "\n".join(problems)
    if entry.sql is None:
        assert rows > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).limit(1).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
