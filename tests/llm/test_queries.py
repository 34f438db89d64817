"""Every registered query of the subpackage runs on the smallest tables."""

import os

import duckdb
import pytest

from casewright.llm.queries import QUERIES
from casewright.llm.sql import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    out = QUERIES[name](spark, SMALL)
    assert out.count() == out.distinct().count() or name in ("p2_copies",)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SMALL).select(*want.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
