"""Decisions, imports, checks and deep redaction on small frames."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import reports as P
from casewright.sources import sinks


@pytest.mark.parametrize(
    ("kind", "text", "repeats", "alternates", "escalation", "left", "environment", "cycling", "strategy"),
    [
        ("tool", "x", 1, 0, False, True, 0, False, "retry_with_advice"), ("verification", None, 1, 0, False, True, 0, False, "alternate_approach"), ("tool", "Permission DENIED", 1, 0, False, True, 1, False, "environment_check"),
        ("tool", "permission denied", 1, 0, False, True, 2, False, "retry_with_advice"), ("tool", "permission denied", 3, 0, False, True, 0, False, "alternate_approach"), ("tool", "x", 3, 2, True, True, 0, False, "escalate_model"),
        ("tool", "x", 3, 2, False, True, 0, True, "ask_user"), ("tool", "x", 1, 0, False, True, 0, True, "alternate_approach"), ("tool", "x", 9, 9, True, False, 0, True, "terminate"),
    ],
)
def test_recovery(spark, kind, text, repeats, alternates, escalation, left, environment, cycling, strategy):
    df = spark.createDataFrame([(kind, text, repeats, alternates, escalation, left, environment, cycling)], "k string, t string, r int, a int, e boolean, l boolean, v int, c boolean")
    assert df.select(P.recovery(*(F.col(c) for c in "ktraelvc"))[0]).first()[0] == strategy


def test_permissions(spark):
    df = spark.createDataFrame([("deny", True, "read"), (None, True, "read"), (None, False, "read"), (None, None, "other")], "r string, c boolean, l string")
    mode, tier = P.permission(F.col("r"), F.col("c"), F.col("l"), {"read": "allow"}, "ask")
    assert [tuple(x) for x in df.select(mode, tier).collect()] == [("deny", "rule"), ("ask", "confirmation"), ("allow", "level"), ("ask", "fallback")]


def test_replacing_imports(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    live = rows(("a", 1), ("b", 2))
    store, bad = P.replaced(live, rows(("c", 3), ("d", 4)), "k")
    assert {r["k"] for r in store.collect()} == {"c", "d"} and bad.count() == 0
    store, bad = P.replaced(live, rows(("c", 3), ("c", 4), ("a", 5), ("a", 6), ("b", 7)), "k")
    assert {r["k"] for r in store.collect()} == {"a", "b"} and {tuple(r) for r in bad.collect()} == {("c", "in file"), ("a", "in file"), ("b", "live")}
    assert P.replaced(live, live.limit(0), "k")[0].count() == 0


def test_faults_of_demonstrations(spark):
    steps = lambda *s: [(t, f'{{"path": "{p}"}}') for t, p in s]
    rows = [
        ("Fix the reader now", steps(("ls", ""), ("read", "a.py"), ("write", "a.py")), "Changed a.py"), ("Fix it", steps(("write", "a.py"), ("read", "a.py")), "done"), (None, None, None), ("One two three", steps(("ls", "x"), ("read", "b")), ""),
    ]
    df = spark.createDataFrame(rows, "g string, s array<struct<tool: string, args: string>>, f string")
    got = [r[0] for r in df.select(P.demonstration_faults(F.col("g"), F.col("s"), F.col("f"), ["ls"], ["read"], ["write"])).collect()]
    assert got[0] == [] and got[1] == ["no look around first", "writes what it has not read", "final answer names no file", "goal under three words"]
    assert "no final answer" in got[2] and got[3] == ["no final answer", "final answer names no file"]


def test_redaction_at_any_depth(spark):
    row = ("ok", [("password: x1", [("k", "sk-abcdefgh12")], 3)], {"token": "AKIA" + "A" * 16}, None)
    df = spark.createDataFrame([row], "a string, b array<struct<c: string, d: array<struct<e: string, f: string>>, n: int>>, m map<string, string>, z struct<y: string, n: int>")
    got = sinks.redacted(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    r = got.first()
    assert r["b"][0]["c"] == "[REDACTED]" and r["b"][0]["d"][0]["f"] == "[REDACTED]" and r["b"][0]["n"] == 3 and r["m"] == {"token": "[REDACTED]"} and r["z"] is None


def test_exit_codes_and_report(spark):
    df = spark.createDataFrame([(1, "error timeout", 1), (2, "error", None), (3, None, 1)], "k int, t string, c int")
    got = {tuple(r) for r in P.rule_matches_with_exit(df, "k", "t", "c", [("a", "error", 1), ("b", "timeout", None)]).collect()}
    assert got == {(1, "a", True), (1, "b", True)}
    cases = spark.createDataFrame([], "id long, signature string, times_seen long, last_seen string")
    assert [r["line"] for r in P.case_report(cases, F.current_timestamp()).collect()] == ["total cases: 0"]
