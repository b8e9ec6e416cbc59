"""Every registered query against its SQL oracle over the driver tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    text = compare(spark, con, FOLDER, name, queries()[name], sql)
    assert text.startswith("ok" if sql else "rows"), text


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["vec_id", "route"] and df.count() > 0
