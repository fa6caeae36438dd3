"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        verdict = compare(df, con, ORACLES[name])
        assert verdict.startswith("ok"), verdict
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = {r["candidate_id"]: r for r in entry.entry(spark).collect()}
    assert rows["exact"]["feasible"] and not rows["defective"]["feasible"]
    assert rows["defective"]["semantic_equivalence"] == "NOT_ASSESSED" and rows["defective"]["rerun_safety"] == "FAIL"
