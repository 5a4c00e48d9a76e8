"""The queries of this subpackage against their SQL, on the driver's smallest tables."""

import os

import pytest

import __spark_entry__
from folioscope.llm import queries
from tests.test_entry import DATA, same, sql  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sql, name):  # noqa: F811
    same(spark, sql, name)


def test_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
