"""Every registered query against its SQL on the smallest given data set."""

import pytest
from compare import compare, connect

from folioscope.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    difference = compare(spark, con, catalogue.QUERIES[name], catalogue.CHECKS.get(name), SF)
    assert difference is None, difference
