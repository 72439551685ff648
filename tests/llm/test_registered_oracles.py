"""Registered queries with an oracle, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from buoyline.llm import queries
from tests.oracle_check import check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(sc, name):
    res = check(sc, name, E.queries()[name], E.oracle_sql()[name], "/root/testdata/sf0.001")
    assert res["ok"], res


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in E.queries()
