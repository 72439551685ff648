"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as E
from buoyline.plans import catalog
from tests.oracle_check import check

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(E.queries()) & set(catalog.queries()))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["device_id", "timestamp"]


def test_every_query_has_an_oracle():
    missing = set(NAMES) - set(E.oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = check(spark, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert res["ok"], res
