import pytest

from railyard import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
#: On the smallest tables these have no solution.
LARGER = {"gravity_ipf"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_is_its_sql(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF.replace("0.001", "0.01") if name in LARGER else SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0
