"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import suite
from __spark_entry__ import entry, oracle_sql, queries
from suite.check import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, name):
    good, text = compare(spark, SF, name, queries()[name], oracle_sql().get(name))
    assert good, text


def test_every_query_has_sql():
    assert set(suite.ORACLES) == set(suite.QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
