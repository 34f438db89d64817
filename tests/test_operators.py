"""Operators against brute force on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.functions.registry import Registry, Tool, load_modules, rule_faults, schema_faults
from casewright.operators import aggregates as A
from casewright.operators import relational as R
from casewright.operators import sequences as S
from casewright.operators.components import connected_components
from casewright.streaming import stores


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(60)] + [(500, 600 + k) for k in range(80)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_flakes_and_regressions(spark):
    cases = spark.createDataFrame([(1, "a", 1, "2031-01-01T00:00:00Z", "x"), (2, "b", 1, "2031-01-05T00:00:00", "unknown"), (3, "c", 5, "2031-01-05T00:00:00Z", "x"), (4, "b", 2, "2031-01-02T00:00:00Z", "x")], "id long, signature string, times_seen long, last_seen string, confirmed_by string")
    flakes = spark.createDataFrame([("b", 3, "2031-01-03T00:00:00Z"), ("b", 3, "2031-01-03T00:00:00Z"), ("c", 9, "2031-01-09T00:00:00Z"), ("z", 1, None)], "signature string, times_passed long, last_pass string")
    assert {(r["signature"], r["pass_rate"], r["chronic"]) for r in R.flaky_rates(cases, flakes).collect()} == {("b", 0.5, False), ("c", 9 / 14, True)}
    assert {(r["signature"], r["kind"]) for r in R.regressions(cases, flakes).collect()} == {("a", "first-time"), ("b", "regression")}
    assert [r["id"] for r in R.pending(cases).collect()] == [2]
    now = F.lit("2031-02-02").cast("timestamp")
    assert {r["id"] for r in R.stale(cases, now, 30).collect()} == {1, 4}
    assert {(r["id"], r["ambiguous"]) for r in R.lookup(cases, flakes.select("signature")).collect()} == {(2, True), (4, True), (3, False)}


def test_joins(spark):
    items = spark.createDataFrame([("A/t :: e", "d"), ("u :: e", "d"), ("v :: e", "d")], "signature string, diagnosis string")
    cases = spark.createDataFrame([("t :: e", "d"), ("u :: e", "other"), ("v :: e", "d"), ("v :: e", "d")], "signature string, diagnosis string")
    assert tuple(R.recall(items, cases).first()) == (1, 3, 33)
    a, b = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x"), (4, 1, "x")], "k int, s int, h string"), spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (3, 1, "y"), (5, 1, "x")], "k int, s int, h string")
    assert {(r["k"], r["status"]) for r in R.full_diff(a, b, "k", "s", "h").collect()} == {(1, "same"), (2, "size drift"), (3, "hash drift"), (4, "missing"), (5, "unlisted")}
    assert {(r["k"], r["change"]) for r in R.changed(a, b, "k", "h").collect()} == {(3, "changed"), (4, "removed"), (5, "new")}
    p = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x")], "g int, w string, v string")
    assert [tuple(r) for r in R.disagreeing_pairs(p, "g", "w", "v").collect()] == [(1, "x", "y", 2)]
    c = spark.createDataFrame([("r", [2, 1]), ("r", [3])], "type string, supporting_cases array<long>")
    assert R.unrejected(c, spark.createDataFrame([("r", [1, 2])], c.schema)).count() == 1


def test_aggregates(spark):
    cases = spark.createDataFrame([(1, "Same text", 3), (2, " same TEXT", 40), (3, "", 1), (4, None, 1)], "id long, t string, times_seen long")
    assert [(r["size"], r["first_id"], r["confidence"]) for r in A.clusters(cases, "t").collect()] == [(2, 1, 0.4)]
    assert {(r["id"], r["confidence"]) for r in A.recurring(cases).collect()} == {(1, 0.15), (2, 1.0)}
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, "x")], "s string, l string")
    assert sorted(r["diversity"] for r in A.rarity(df, ["s", "l"]).collect()) == [0.5, 0.5, 0.75, 0.75]
    mean, unknown = A.mean_known({"a": F.lit(1.0), "b": F.lit(None).cast("double"), "c": F.lit(0.5)})
    assert tuple(spark.range(1).select(mean, unknown).first()) == (0.75, ["b"])
    goals = spark.createDataFrame([(1, "Fix it!", "2031-01"), (2, "fix it", "2031-02"), (3, "other", "2031-01")], "k long, goal string, at string")
    assert {(r["k"], r["superseded"]) for r in A.newest_per_goal(goals, "goal", [F.col("at"), F.col("k")]).collect()} == {(1, True), (2, False), (3, False)}


def test_sequences(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabbbca")] + [(2, 0, None), (2, 1, None)], "g int, k int, v string")
    assert {(r["g"], r["longest"]) for r in S.longest_run(df, "g", [F.col("k")], "v").collect()} == {(1, 3), (2, 2)}
    assert spark.createDataFrame([(list("aabbba"),), ([],)], "a array<string>").select(S.longest_run_in(F.col("a")).alias("n")).collect() == [(3,), (0,)]
    assert {(r["g"], r["tail"]) for r in S.tail_run(df, "g", [F.col("k")], F.col("v").isin("c", "a")).collect()} == {(1, 2), (2, 0)}
    e = spark.createDataFrame([(1, k, v) for k, v in enumerate(["x", "x", "fix", "y", "ok", "x"])], "g int, k int, v string")
    got = {tuple(r) for r in S.error_islands(e, "g", [F.col("k")], F.when(F.col("v").isin("x", "y"), F.col("v")), F.col("v") == "fix").collect()}
    assert got == {(1, 1, "x", True), (1, 2, "y", False), (1, 3, "x", False)}
    level = spark.createDataFrame([([True] * 7,), ([True] * 3 + [False] * 2,), ([],)], "a array<boolean>").select(S.adaptive_level(F.col("a")).alias("n")).collect()
    assert [r["n"] for r in level] == [3, 1, 1]
    edits = spark.createDataFrame([([("p", "q"), ("q", "p")],), ([("p", "q"), ("p", "q")],)], "e array<struct<a: string, b: string>>")
    assert [r[0] for r in edits.select(S.reverted_in(F.col("e"))).collect()] == [True, False]
    assert [r[0] for r in spark.createDataFrame([([1, 1, 0],), ([0, 0, 0],), ([1, 0],)], "c array<int>").select(S.proved_by_tests_in(F.col("c"))).collect()] == [True, False, False]


def test_round_robin_takes_turns(spark):
    rows = [(f"g{g}", k) for g in range(3) for k in range((6, 2, 3)[g])]
    df = spark.createDataFrame([(g, n, k) for n, (g, k) in enumerate(rows)], "g string, n int, k int")
    got = {(r["g"], r["k"]) for r in S.round_robin(df, "g", [F.col("k")], 7, F.col("n")).collect()}
    assert got == {("g0", 0), ("g1", 0), ("g2", 0), ("g0", 1), ("g1", 1), ("g2", 1), ("g0", 2)}


@pytest.mark.parametrize("ranked", [1000, 2])
def test_round_robin_equals_a_fold(spark, monkeypatch, ranked):
    monkeypatch.setattr(S, "RANKED", ranked)
    rng = random.Random(11)
    rows = [(rng.choice([None, *"abcdefgh", *"a" * 20]), n) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, n int")
    groups = {}
    for g, n in rows:
        groups.setdefault(g, []).append(n)
    draw = [n for k in range(300) for g, ns in sorted(groups.items(), key=lambda x: x[1][0]) for n in ns[k : k + 1]]
    for budget in (0, 1, 9, 40, 123, 299, 300, 1000):
        assert {r["n"] for r in S.round_robin(df, "g", [F.col("n")], budget, F.col("n")).collect()} == set(draw[:budget]), budget
    assert S.round_robin(df.limit(0), "g", [F.col("n")], 5, F.col("n")).count() == 0


def test_numbers_over_all_rows(spark):
    df = spark.createDataFrame([((k * 37) % 500, "abc"[k % 3]) for k in range(500)], "k int, g string").repartition(7)
    assert all(r["pos"] == r["k"] + 1 for r in S.numbered(df, [F.col("k")], "pos").collect())
    own = S.numbered(df, [F.desc("k")], "pos", ("g",)).collect()
    for g in "abc":
        assert [r["pos"] for r in sorted((r for r in own if r["g"] == g), key=lambda r: -r["k"])] == list(range(1, 1 + sum(r["g"] == g for r in own)))


def test_failure_ladder_stream_equals_batch_equals_fold(spark, tmp_path):
    rng = random.Random(9)
    rows = [(u, k, rng.random() < 0.3, rng.choice("pqr")) for u in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "u long, seq long, ok boolean, s string")
    want = set()
    for u in range(6):
        state = (0, [], 0)
        for (_, k, ok, s) in [r for r in rows if r[0] == u]:
            (streak, name, state), *_ = stores.ladder_fold([(ok, s)], state)
            want.add((u, k, streak, name))
    assert {tuple(r) for r in stores.failure_ladder_batch(df, "u", "seq", "ok", "s").collect()} == want
    df.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = stores.failure_ladder(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*")), "u", "seq", "ok", "s")
    for part in (1, 2):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        if part == 1:
            df.where("seq >= 20").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_change_feed_and_history(spark):
    scans = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2), ("c", "1", 2)], "k string, h string, n int")
    assert {tuple(r) for r in stores.change_feed(scans, "k", "h", "n").collect()} == {("a", 2, "changed"), ("b", 2, "removed"), ("c", 2, "new")}
    e = spark.createDataFrame([("s", k) for k in range(1, 8)], "s string, seq long")
    assert {r["seq"] for r in stores.history(e, "s", 3).collect()} == {5, 6, 7}


def test_registry(tmp_path):
    r = Registry()
    r.add(Tool("upper", "upper case", lambda text: text.upper(), ("text",)))
    assert r.call("upper", text="a") == "A" and r.call("none") == "unknown tool: none" and r.call("upper") == "upper: missing text" and r.call("upper", text=3).startswith("upper failed")
    (tmp_path / "good.py").write_text("from casewright.functions.registry import Tool\nTOOLS = [Tool('x', 'd', len)]\n")
    (tmp_path / "bad.py").write_text("1/0")
    tools, faults = load_modules(str(tmp_path))
    assert [t.name for t in tools] == ["x"] and [f[0] for f in faults] == ["bad.py"]
    assert rule_faults({"id": "1", "pattern": "(", "classification": "c", "exit_code": True}) != [] and rule_faults({"id": "1", "pattern": "a", "classification": "c"}) == []
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert schema_faults({"a": 1, "b": [1]}, schema) == [] and schema_faults({"a": True, "b": [3]}, schema) == ["value.a: no integer", "value.b[0]: not one of [1, 2]"]
