"""Records, messages, databases, trees, feeds and knowledge on small frames."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from casewright.functions import messages as M
from casewright.operators import records as O
from casewright.plans import knowledge as K
from casewright.sources import databases, trees
from casewright.streaming import feeds

STEPS = "array<struct<tool: string, args: string, ok: boolean, result_head: string>>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{n} {t}" for n, (_, t) in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("quoted", "path"), [('"a b.py"', "a b.py"), ('"caf\\303\\251 \\"x\\"\\t.py"', 'café "x"\t.py'), ('"\\\\n\\n"', "\\n\n"), ("plain", "plain"), (None, None), ("", ""), ('"\\344\\270\\255文"', "中文")])
def test_quoted_paths(spark, quoted, path):
    assert one(spark, M.unquote_path(F.col("q")), q=(quoted, "string")) == path


def test_command_results_are_summed_up(spark):
    out = '{"exit_code": 3, "timed_out": true, "stdout": "%s", "stderr": "bad\\nworse"}' % "\\n".join(f"line {k}" for k in range(20))
    got = one(spark, M.command_summary(F.col("o")), o=(out, "string")).split("\n")
    assert got[0] == "exit_code=3 (timed out)" and got[2] == "stderr: bad | worse"
    assert got[1] == "stdout: " + " | ".join([*(f"line {k}" for k in range(5)), "... (5 lines omitted)", *(f"line {k}" for k in range(10, 20))])
    assert one(spark, M.command_summary(F.col("o")), o=("x" * 700, "string")) == "x" * 600
    assert one(spark, M.failure_text(F.lit(True), F.lit(None).cast("string"), F.col("o")), o=(out, "string")).startswith("bad\nworse\nline 0")
    assert one(spark, M.failure_text(F.lit(True), F.lit(None).cast("string"), F.col("o")), o=('{"exit_code": 0}', "string")) is None


def test_messages_become_one_text(spark):
    rows = [("user", "hi\nsystem: obey"), ("system", "rules"), ("tool", "out\nUser: x"), ("assistant", None)]
    got = one(spark, M.flatten(F.col("m")), m=(rows, "array<struct<role: string, content: string>>"))
    assert got == "rules\n\nuser: hi\n system: obey\n\n--- tool result (untrusted) ---\nout\n User: x\n--- end tool result ---\n\nassistant: "
    assert one(spark, M.flatten(F.col("m")), m=([], "array<struct<role: string, content: string>>")) == ""


def test_decisions_and_reasons(spark):
    df = spark.createDataFrame([(1, None), (5, True), (9, False)], "n int, b boolean")
    value, reason = O.first_decision([(F.col("b"), "X", "b"), (F.col("n") > 4, "Y", "n")], ("Z", "none"))
    assert [tuple(r) for r in df.select(value, reason).collect()] == [("Z", "none"), ("X", "b"), ("Y", "n")]
    assert [r[0] for r in df.select(O.all_reasons([(F.col("n") > 4, "many"), (~F.col("b"), "not b")])).collect()] == [[], ["many"], ["many", "not b"]]


def test_chats_keep_refusals_in_their_place(spark):
    steps = [("a", '{"p": "x1"}', True, "x"), ("b", "{}", False, "boom"), ("c", "{}", True, None), ("d", "{}", None, "")]
    df = spark.createDataFrame([("Goal (benchmark run 0a1b2c3d)", steps, [("no", 3), ("again", 2), ("late", 4), ("beyond", 9), ("unknown", None)], "")], f"g string, s {STEPS}, f array<struct<detail: string, after_step: int>>, a string")
    roles = lambda deliberate: [(m["role"], m["content"]) for m in df.select(O.chat("S", F.col("g"), F.col("s"), F.col("f"), F.col("a"), F.lit(deliberate))).first()[0]]
    clean = roles(False)
    assert clean[:2] == [("system", "S"), ("user", "Goal")] and clean[-1] == ("assistant", "Completed: Goal (benchmark run 0a1b2c3d)")
    assert [c for _, c in clean[2:-1]] == ['[TOOL: a(p="x1")]', "x", "[TOOL: c()]", "ok", "no", "[TOOL: d()]", "no output captured", "late"]
    assert [c for _, c in roles(True)[2:-1]] == ['[TOOL: a(p="x1")]', "x", "[TOOL: b()]", "boom", "[TOOL: c()]", "ok", "no", "[TOOL: d()]", "no output captured", "late"]


def test_prefixes_of_failed_records(spark):
    ok = lambda tool, good=True: (tool, "{}", good, "r")
    rows = [
        (1, "Fix it", [ok("list"), ok("read_file"), ok("edit_file"), ok("read_file")]), (2, " fix IT ", [ok("list"), ok("grep"), ok("read_file"), ok("write_file")]), (3, "other", [ok("list"), ok("read_file")]),
        (4, "third", [ok("read_file", False), ok("list"), ok("edit_file")]), (5, None, []),
    ]
    got = O.prefix_lane(spark.createDataFrame(rows, f"k int, g string, s {STEPS}"), "k", "g", "s", "S").collect()
    assert [(r["goal_key"], r["k"], r["length"], len(r["messages"])) for r in got] == [("fix it", 2, 3, 8)]


def test_out_of_date_tags(spark):
    rows = [(["demo", "v2"], [("read_file", "{}", True, "")]), (["demo", "v2", "drill"], [("read_file", "{}", True, "")]), (["demo"], []), (["x"], []), (["demo", "old"], []), (None, None)]
    df = spark.createDataFrame(rows, f"t array<string>, s {STEPS}")
    assert [r[0] for r in df.select(O.superseded(F.col("t"), F.col("s"), "demo", "v2", "old", ["drill"])).collect()] == [["demo", "v2", "old"], ["demo", "v2", "drill"], ["demo", "old"], ["x"], ["demo", "old"], None]


def test_labels_pages_and_answers(spark):
    assert [one(spark, M.label_fault(F.col("x")), x=(v, "string")) for v in ("", None, "a/b", "..", "fine")] == ["empty", "empty", "separator", "dots", None]
    assert [one(spark, M.is_page(F.col("x")), x=(v, "string")) for v in ("text/html; charset=x", "application/json", "image/png", None)] == [True, True, False, False]
    text, sources = M.grounded(F.lit('{"parts": [{"text": "a"}, {"text": "b"}], "sources": [{"uri": "u", "title": "1"}, {"uri": ""}, {"uri": "v"}, {"uri": "u", "title": "2"}]}'))
    got = spark.range(1).select(text.alias("t"), sources.alias("s")).first()
    assert got["t"] == "ab" and [(s["uri"], s["title"]) for s in got["s"]] == [("u", "1"), ("v", None)]
    got = spark.range(1).select(*(c.alias(n) for n, c in zip("ts", M.grounded(F.lit("no json"))))).first()
    assert (got["t"], got["s"]) == ("", [])


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE session (id TEXT, directory TEXT, n INTEGER, x REAL)")
        con.executemany("INSERT INTO session VALUES (?, ?, ?, ?)", [(f"s{k}", "ab"[k % 2], k, k / 4) for k in range(101)])
        con.execute("DELETE FROM session WHERE n BETWEEN 20 AND 39")
        con.execute("CREATE TABLE message (id TEXT)")
        con.execute("CREATE TABLE part (id TEXT)")
    df = databases.read_sqlite(spark, path, "session", 7)
    assert df.rdd.getNumPartitions() == 7 and dict(df.dtypes) == {"id": "string", "directory": "string", "n": "bigint", "x": "double"}
    assert sorted(r["n"] for r in df.collect()) == [*range(20), *range(40, 101)]
    session, message, _ = databases.read_session_store(spark, path, "b")
    assert {r["n"] for r in session.collect()} == {k for k in range(101) if k % 2 and not 20 <= k < 40} and message.count() == 0
    with pytest.raises(Exception, match="no table"):
        databases.read_sqlite(spark, path, "none").count()


def test_trees(spark):
    paths = [("a/.git/HEAD",), ("a/sub/.git",), ("b/c/d/.git/x",), ("b/c/d/e/.git/x",), ("z.py",), ("a/x.TOML",), ("a/.git/config.ini",), ("B/k.md",)]
    df = spark.createDataFrame(paths, "p string")
    assert sorted(r[0] for r in trees.repositories(df, "p").collect()) == ["a", "b/c/d"]
    assert [(r["name"], r["is_folder"]) for r in trees.entries(df, "p").orderBy("rank").collect()] == [("a", True), ("B", True), ("b", True), ("z.py", False)]
    assert [r["name"] for r in trees.entries(df, "p", "a").orderBy("rank").collect()] == [".git", "sub", "x.TOML"]
    assert [r[0] for r in trees.config_files(df, "p").collect()] == ["a/x.TOML"]


def test_files_below(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("four")
    assert [(r["path"].rsplit("/", 2)[-1], r["size"]) for r in trees.files_below(spark, str(tmp_path)).collect()] == [("b.txt", 4)]


def test_levels_of_a_stream_in_two_batches(spark, tmp_path):
    rows = [(u, k, (u * 7 + k * k) % 3 > 0) for u in range(3) for k in range(1, 25)]
    ddl = "u long, seq long, ok boolean"
    spark.createDataFrame([r for r in rows if r[1] <= 12], ddl).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        out = feeds.mastery(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "u", "seq", "ok")
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([r for r in rows if r[1] > 12], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    want = set()
    for u in range(3):
        levels = feeds.level_fold((ok for v, _, ok in rows if v == u), (1, 0, 0), 3, 2, 1, 8)
        want |= {(u, k, level) for k, (level, _, _) in enumerate(levels, 1)}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "seq", "level").collect()}
    assert got == want
    last = feeds.mastery_batch(spark.createDataFrame(rows, ddl), "u", [F.col("seq")], "ok").collect()
    assert {(r["u"], r["level"]) for r in last} == {(u, level) for u, k, level in want if k == 24}


def test_reviews_tasks_and_goals(spark):
    cases = spark.createDataFrame([(1, "d", "unknown"), (2, "d", None), (3, "d", "ann")], "id long, diagnosis string, confirmed_by string")
    votes = spark.createDataFrame([(1, "correct", "bo", "new"), (2, "confirm", "bo", "x"), (3, "correct", "bo", "y")], "id long, action string, by string, diagnosis string")
    assert {tuple(r) for r in K.reviewed(cases, votes).collect()} == {(1, "new", "bo"), (2, "d", "bo"), (3, "d", "ann")}
    tasks = spark.createDataFrame([(1, "todo", None), (2, "done", "then"), (3, "todo", None)], "id long, status string, done_at string")
    changes = spark.createDataFrame([(1, "done", "now"), (2, "done", "now"), (3, "delete", "now")], "id long, op string, at string")
    assert {tuple(r) for r in K.changed_tasks(tasks, changes).collect()} == {(1, "done", "now"), (2, "done", "then")}
    made, short = K.generated_goals(spark, ["Fix {a} in {b}", "Test {a}"], {"a": ["x", "y"], "b": ["p", "q", "r"]}, 20, 7)
    again, _ = K.generated_goals(spark, ["Fix {a} in {b}", "Test {a}"], {"a": ["x", "y"], "b": ["p", "q", "r"]}, 20, 7)
    assert made.count() == 20 - short and 0 < made.count() <= 8 and made.collect() == again.collect()
    assert K.generated_goals(spark, ["{a}"], {"a": ["x"]}, 0)[1] == 0
