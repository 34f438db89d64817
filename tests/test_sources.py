"""Record files, text scans, sessions, pages and code."""

import json

import pytest
from pyspark.sql import functions as F

from casewright.sources import jsonl, pages, sessions, sinks
from casewright.sources import text as T

CASE = {"id": 1, "signature": "t :: e", "error_excerpt": "e", "diagnosis": "d", "times_seen": 1, "last_seen": "2031-01-01T00:00:00Z", "confirmed_by": "a"}


def write(path, rows, bom=False, end="\n"):
    path.write_bytes(("\ufeff" * bom + end.join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end).encode())
    return str(path)


def test_strict_scan(spark, tmp_path):
    rows = [CASE, "", CASE | {"id": 4, "merged_from": 2}]
    got = jsonl.read_cases(spark, write(tmp_path / "a.jsonl", rows, bom=True, end="\r\n")).orderBy("id").collect()
    assert [(r["id"], r["merged_from"]) for r in got] == [(1, None), (4, 2)]
    assert jsonl.read_cases(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    rows = [CASE | {"id": k, "diagnosis": "d" * (k % 90)} if k % 7 else "" for k in range(1, 900)]
    path = write(tmp_path / "s.jsonl", rows, bom=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = jsonl.lines(spark, path)
        assert got.select("block").distinct().count() > 5
        assert sorted((r["line_no"], json.loads(r["line"])["id"]) for r in got.collect()) == [(k, k) for k in range(1, 900) if k % 7]
        assert jsonl.read_cases(spark, path).count() == sum(1 for r in rows if r)
        swapped = [CASE | {"id": k} for k in [*range(1, 300), 5, *range(301, 400)]]
        with pytest.raises(jsonl.RecordError, match="line 300: ids must rise"):
            jsonl.read_cases(spark, write(tmp_path / "w.jsonl", swapped))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    ("bad", "why"),
    [({"id": True}, "bad type of id"), ({"id": 0}, "id below 1"), ({"times_seen": 0}, "times_seen below 1"), ({"last_seen": "yesterday"}, "ISO-8601"), ({"diagnosis": None}, "bad type of diagnosis"), ({"times_seen": 1.5}, "bad type of times_seen"), ({"id": 1}, "ids must rise")],
)
def test_first_bad_line(spark, tmp_path, bad, why):
    rows = [CASE, CASE | {"id": 2} | bad, "broken {"]
    with pytest.raises(jsonl.RecordError, match=f"line 2: .*{why}"):
        jsonl.read_cases(spark, write(tmp_path / "b.jsonl", rows))


def test_other_scans(spark, tmp_path):
    assert jsonl.read_flakes(spark, write(tmp_path / "f", [{"signature": "s", "times_passed": 2, "last_pass": "2031-01-01T00:00:00Z"}])).count() == 1
    assert jsonl.read_tasks(spark, write(tmp_path / "t", [{"id": 0, "title": "x", "status": "todo", "created": "c", "done_at": None}])).count() == 1
    with pytest.raises(jsonl.RecordError, match="unknown status"):
        jsonl.read_tasks(spark, write(tmp_path / "t2", [{"id": 0, "title": "x", "status": "maybe", "created": "c"}]))
    with pytest.raises(FileNotFoundError):
        jsonl.read_holdout(spark, str(tmp_path / "h0"))
    with pytest.raises(jsonl.EmptyHoldout):
        jsonl.read_holdout(spark, write(tmp_path / "h", [""]))
    e = jsonl.read_experiences(spark, write(tmp_path / "e", [{"experience_id": "x", "goal": "g", "outcome": "success"}])).first()
    assert (e["actions"], e["confidence"], e["times_seen"]) == ([], 0.5, 1)
    with pytest.raises(jsonl.RecordError, match="unknown outcome"):
        jsonl.read_experiences(spark, write(tmp_path / "e2", [{"goal": "g", "outcome": "maybe"}]))
    good, bad = write(tmp_path / "l", [CASE, CASE]), write(tmp_path / "l2", [CASE, "x"])
    assert jsonl.read_lenient(spark, good, "id BIGINT").count() == 2 and jsonl.read_lenient(spark, bad, "id BIGINT").count() == 0
    run = {"run_id": "r", "started_at": "s", "models": ["m"], "results": {"m": {"a": {"success": True, "iterations": 2}, "b": {"success": False}}}}
    assert {(r["model"], r["task"], r["success"]) for r in jsonl.read_eval_runs(spark, write(tmp_path / "run.json", [run])).collect()} == {("m", "a", True), ("m", "b", False)}
    packs = jsonl.read_rule_packs(spark, write(tmp_path / "p.json", [{"name": "n", "rules": [{"id": "1", "pattern": "x", "exit_code": 1}, {"id": "2", "exit_code": 300}]}])).collect()
    assert [r["error"] for r in packs] == [None, "no pattern or too long"]
    assert jsonl.read_manifest(spark, write(tmp_path / "m.json", [{"files": [{"path": "a", "size": 1, "sha256": "h"}]}])).count() == 1
    assert jsonl.read_ledger(spark, write(tmp_path / "g.json", [{"version": 2, "files": {}}])).count() == 0
    assert jsonl.read_skills(spark, write(tmp_path / "s.json", [{"name": "Bad Name", "goal": "g"}])).first()["error"] == "bad name"


def test_round_trip_of_written_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "a", 5)], "id long, t string, n long")
    path = str(tmp_path / "out.jsonl")
    assert sinks.write_lines(df, path, ["id"]) == 2 and sinks.write_lines(df, path, ["id"]) == 2
    assert open(path, encoding="utf-8").read() == '{"id":1,"t":"a","n":5}\n{"id":2,"t":"é","n":null}\n'
    assert sinks.redacted(spark.createDataFrame([("password: x1", ["sk-abcdefgh12"])], "a string, b array<string>")).first() == ("[REDACTED]", ["[REDACTED]"])


def test_digest_upsert(spark):
    live = spark.createDataFrame([(7, "s", "h", "one", "", "old")], "id long, source string, heading string, content string, content_hash string, digested_at string")
    live = live.withColumn("content_hash", F.sha2("content", 256))
    new = spark.createDataFrame([("s", "h", " one ", "now"), ("s", "h", "two", "now"), ("t", "h", "two", "now"), ("s", "h", "three", "now")], "source string, heading string, content string, digested_at string")
    got = {r["content"]: (r["id"], r["digested_at"]) for r in sinks.merge_digest(live, new).collect()}
    assert got["one"] == (7, "now") and sorted(v[0] for v in got.values()) == [7, 8, 9]


def test_markdown_and_logs(spark):
    docs = spark.createDataFrame([("d/a.md", "intro\n# One\ntext\n\n## Two\n# Three\nmore"), ("b.md", ""), ("c.md", None)], "p string, t string")
    got = sorted((r["p"], r["pos"], r["heading"], r["content"]) for r in T.markdown_sections(docs, "p", "t").collect())
    assert [g[:1] + g[2:] for g in got] == [("b.md", "b", "(empty document)"), ("c.md", "c", "(empty document)"), ("d/a.md", "a", "intro"), ("d/a.md", "One", "text"), ("d/a.md", "Three", "more")]
    rows = spark.createDataFrame([("## 2031 hello world",), ("other",), ("1a2b3c4d fix: the loader",), ("1a2b3c4e add x",)], "line string")
    assert [tuple(r) for r in T.journal_entries(rows).collect()] == [("2031", "hello world")]
    assert [r["signature"] for r in T.commit_cases(rows).collect()] == ["the loader :: fixed in 1a2b3c4d"]
    talk = spark.createDataFrame([(1, "test_alpha\nok\nFAIL: boom in a/b.py\nERROR: other\n"), (2, "FAIL: lonely"), (3, None)], "k int, t string")
    assert sorted(r["signature"] for r in T.transcript_cases(talk, "k", "t").collect()) == ["test_alpha :: boom in b.py", "test_alpha :: other", "unknown_test :: lonely"]
    log = spark.createDataFrame([(1, "# x\n## D-12 [old] Loader failed\nRoot cause: the loader read a stale manifest from disk.\nFAIL: no file\n## Lunch\nnothing at all")], "k int, t string")
    kept = T.mined({"log": T.decision_cases(log, "k", "t"), "talk": T.transcript_cases(talk, "k", "t").union(T.transcript_cases(talk, "k", "t"))}, ["k", "pos"]).collect()
    assert sorted((r["source"], r["signature"]) for r in kept)[0] == ("log", "loader failed :: fail: no file") and len(kept) == 4
    assert T.exported(T.decision_cases(log, "k", "t")).first()["confirmed_by"] == "archive-mine"
    case = T.decision_cases(log, "k", "t").first()
    assert case["diagnosis"].startswith("the loader read") and case["signature"] == "loader failed :: fail: no file"


def test_git_text(spark):
    rows = spark.createDataFrame([("## main...origin/main [ahead 2, behind 1]",), (" M a.py",), ("R  old.py -> new.py",), ('?? "sp ace"',), ("a\x1fb\x1fc\x1fd\x1fe",), ("a\x1fb",)], "line string")
    assert tuple(T.branch_header(rows).first()) == ("main", False, 2, 1)
    entries = {r["path"]: r["origin"] for r in T.porcelain_status(rows.where("line NOT LIKE '%\x1f%'")).collect()}
    assert entries == {"a.py": None, "new.py": "old.py", "sp ace": None}
    assert T.numbered_log(rows).count() == 1
    docs = spark.createDataFrame([("f", "one\ntwo Needle\nthree")], "k string, t string")
    assert [tuple(r) for r in T.grep_lines(docs, "k", "t", "needle").collect()] == [("f", 2, "two Needle")]
    assert [r["line"] for r in T.line_window(docs, "k", "t", 2, 5).collect()] == ["two Needle", "three"]


def test_sessions(spark):
    session = spark.createDataFrame([("s1", "/a", 1), ("s2", "/a", 2), ("s3", "/b", 3)], "id string, directory string, time_created long")
    message = spark.createDataFrame([("m1", "s1", 1, '{"role": "user"}'), ("m2", "s1", 2, '{"role": "assistant"}')], "id string, session_id string, time_created long, data string")
    part = [("p1", "m1", "s1", 1, {"type": "text", "text": "continue"}), ("p2", "m1", "s1", 2, {"type": "text", "text": "Fix the loader"}), ("p3", "m2", "s1", 3, {"type": "tool", "tool": "read"}), ("p4", "m2", "s1", 4, {"type": "tool", "tool": "edit"})]
    part = spark.createDataFrame([(*p[:4], json.dumps(p[4])) for p in part], "id string, message_id string, session_id string, time_created long, data string")
    parts = sessions.parts_with_role(message, part)
    out = sessions.as_experiences(session, sessions.session_volume(session, message, part), sessions.first_goal(parts), sessions.tool_actions(parts), "mined")
    row = out.first()
    assert out.count() == 1 and (row["goal"], row["actions"], row["tool_count"], row["part_count"]) == ("Fix the loader", ["read", "edit"], 2, 4)
    stats = {r["directory"]: (r["seen"], r["mined"]) for r in sessions.mine_stats(session, out).collect()}
    assert stats == {"/a": (2, 1), "/b": (1, 0), None: (3, 1)}
    t = spark.createDataFrame([("s", '[{"info": {"role": "user"}, "parts": [{"type": "text", "text": "Do x"}, {"type": "tool", "tool": "run"}]}]'), ("t", "{}")], "session_id string, transcript string")
    p = sessions.transcript_parts(t)
    assert [r["goal"] for r in sessions.first_goal(p).collect()] == ["Do x"] and sessions.tool_actions(p).first()["tool_count"] == 1


def test_pages_and_code(spark):
    html = "<title>A &amp; b</title><script>no</script><p>Hi <a href='/x'>link <b>t</b></a></p>"
    row = pages.extract_pages(spark.createDataFrame([(1, "https://h.example/d/", html), (2, None, None)], "k int, u string, h string"), "k", "u", "h").orderBy("k").collect()
    assert (row[0]["title"], row[0]["text"], row[0]["links"][0]["url"], row[0]["links"][0]["text"]) == ("A & b", "Hi link t", "https://h.example/x", "link")
    assert row[1]["text"] == "" and row[1]["links"] == []
    code = [("a.py", "import os\nfrom .b import c\nX = 1\nclass K:\n    def m(self):\n        return os.path\n"), ("b.ts", "export const f = (x) => x\nimport { y } from './z'\nclass Q {}"), ("c.go", "func main() {}"), ("bad.py", "def ("), ("n.py", None)]
    facts = pages.extract_code(spark.createDataFrame(code, "path string, t string"), "path", "t")
    defined = {(r["path"], r["name"], r["kind"]) for r in facts.where("fact = 'definition'").collect()}
    assert defined == {("a.py", "X", "variable"), ("a.py", "K", "class"), ("a.py", "m", "method"), ("b.ts", "f", "variable"), ("b.ts", "Q", "class"), ("c.go", "main", "symbol")}
    assert [r["path"] for r in pages.importers(facts, "os").collect()] == ["a.py"] and facts.where("fact = 'diagnostic'").first()["path"] == "bad.py"
    assert pages.references(facts, "path").count() == 1 and pages.definitions(facts, "k", exact=False).count() == 1
