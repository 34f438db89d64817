"""Every registered query beside its SQL on the smallest tables."""

import ast
import os
from decimal import Decimal

import duckdb
import pytest

from casewright.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal | float):
        return round(float(v), 6)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert rows == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())


def test_only_queries_over_python_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"python_facts", "code_definitions", "code_references", "code_importers"}


def test_python_facts(spark):
    """Of every document, read as Python, what its own syntax tree says; what can't be parsed is a diagnostic."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    facts = QUERIES["python_facts"](spark, SMALL).collect()
    want = {}
    for k, text in rows:
        try:
            names = [(n.id, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
        except (SyntaxError, ValueError):
            names = None
        want[f"{k}.py"] = names
    assert {r["path"] for r in facts if r["fact"] == "diagnostic"} == {p for p, n in want.items() if n is None}
    assert sorted((r["path"], r["name"], r["line"]) for r in facts if (r["fact"], r["kind"]) == ("reference", "name")) == sorted((p, *x) for p, n in want.items() for x in n or ())


def test_lookups_in_facts(spark):
    """Definitions, references and importers are those rows of the facts that the lookup names."""
    every = [r for name in ("code_facts", "python_facts", "script_facts") for r in QUERIES[name](spark, SMALL).collect()]
    assert {(r["path"], r["line"]) for r in QUERIES["code_references"](spark, SMALL).collect()} == {(r["path"], r["line"]) for r in every if r["fact"] == "reference" and r["name"] == "load"}
    assert {(r["path"], r["line"]) for r in QUERIES["code_definitions"](spark, SMALL).collect()} == {(r["path"], r["line"]) for r in every if r["fact"] == "definition" and "load" in r["name"].lower()}
    got = {(r["path"], r["name"]) for r in QUERIES["code_importers"](spark, SMALL).collect()}
    assert got == {(r["path"], r["name"]) for r in every if r["fact"] == "import" and (r["name"] == "os" or r["name"].startswith("os.") or r["name"].endswith(".os"))}
