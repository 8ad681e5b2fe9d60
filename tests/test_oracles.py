import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n in entry.catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(spark, con, entry.catalog.QUERIES[name], entry.catalog.ORACLES[name], SF_DIR) is None


def test_every_query_runs(spark):
    for name in sorted(set(entry.catalog.QUERIES) - set(entry.catalog.ORACLES)):
        assert entry.catalog.QUERIES[name](spark, SF_DIR).limit(5).collect() is not None, name
