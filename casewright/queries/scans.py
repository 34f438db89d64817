"""Queries of scans, writers and text functions: what is written is read back, with DuckDB SQL over the tables it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import aggregates as A
from casewright.operators import checks as C
from casewright.operators import sequences as S
from casewright.plans.session import scratch
from casewright.queries.core import ORACLES, _ONCE_E, _ONCE_T, _RUN, _STRIP, _once, _runs, _sql_canonical, _t, query
from casewright.sources import jsonl, sessions, sinks
from casewright.sources import text as T
from casewright.streaming import stores


def _file(spark: SparkSession, df: DataFrame, order: list[str]) -> str:
    """A JSON Lines file of ``df`` in the shared folder."""
    path = f"{scratch(spark)}/rows.jsonl"
    sinks.write_lines(df, path, order)
    return path


def _e(spark, d):
    return _once(_t(spark, d, "experiences"), "experience_id")


def _tr(spark, d):
    return _once(_t(spark, d, "trajectories"), "traj_id")


# ---- record files ----------------------------------------------------------------------------------------------------


@query("SELECT id, coalesce(signature, '') AS signature, coalesce(error_excerpt, '') AS error_excerpt, coalesce(diagnosis, '') AS diagnosis, times_seen, last_seen, coalesce(confirmed_by, '') AS confirmed_by, merged_from FROM cases")
def cases_file(spark, d):
    """The case base, written and read strictly."""
    c = _t(spark, d, "cases").fillna("", ["signature", "error_excerpt", "diagnosis", "confirmed_by"])
    return jsonl.read_cases(spark, _file(spark, c, ["id"]))


@query("SELECT signature, times_passed, last_pass FROM flakes WHERE signature IS NOT NULL AND times_passed IS NOT NULL AND last_pass IS NOT NULL")
def flakes_file(spark, d):
    """The log of passes, written and read strictly."""
    f = _t(spark, d, "flakes").where("signature IS NOT NULL AND times_passed IS NOT NULL AND last_pass IS NOT NULL")
    return jsonl.read_flakes(spark, _file(spark, f, ["signature", "last_pass", "times_passed"]))


@query("SELECT signature, diagnosis FROM holdout")
def holdout_file(spark, d):
    """The frozen test set, written and read strictly."""
    return jsonl.read_holdout(spark, _file(spark, _t(spark, d, "holdout").select("signature", "diagnosis"), ["signature", "diagnosis"]))


@query(f"SELECT experience_id, session_id, goal, outcome, context, array_to_string(actions, ',') AS actions, failure, confidence, times_seen, len(tags) AS tags, recorded_at FROM ({_ONCE_E}) WHERE trim(coalesce(goal, '')) <> ''")
def experiences_file(spark, d):
    """Experiences, written and read with their defaults."""
    e = _e(spark, d).where("trim(coalesce(goal, '')) <> ''").drop("verification")
    got = jsonl.read_experiences(spark, _file(spark, e, ["experience_id"]))
    return got.select("experience_id", "session_id", "goal", "outcome", "context", F.array_join("actions", ",").alias("actions"), "failure", "confidence", "times_seen", F.size("tags").cast("bigint").alias("tags"), "recorded_at")


_RULES = "SELECT min(id) AS id, 'cluster' AS type, lower(substr(signature, 1, 20)) AS description, count(*) AS n FROM cases WHERE signature IS NOT NULL GROUP BY 3 HAVING count(*) >= 2"


def _rules(spark, d):
    key = F.lower(F.substring("signature", 1, 20)).alias("description")
    return _t(spark, d, "cases").where("signature IS NOT NULL").groupBy(key).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n >= 2").withColumn("type", F.lit("cluster"))


@query(f"SELECT id, type, description, least(n / 20, 1.0) AS confidence, id AS first_case, 'rule ' || id AS proposed_rule FROM ({_RULES})")
def proposed_rules_file(spark, d):
    """Proposed rules, written and read strictly."""
    r = _rules(spark, d).select("id", "type", "description", F.least(F.col("n") / 20, F.lit(1.0)).alias("confidence"), F.array("id").alias("supporting_cases"), F.concat(F.lit("rule "), "id").alias("proposed_rule"), F.lit("2031-01-01T00:00:00Z").alias("created"))
    return jsonl.read_proposed_rules(spark, _file(spark, r, ["id"])).select("id", "type", "description", "confidence", F.col("supporting_cases")[0].alias("first_case"), "proposed_rule")


@query(f"SELECT type, id AS first_case, n AS second_case, CASE WHEN n > 3 THEN 'teacher' END AS rejected_by, description AS reason FROM ({_RULES})")
def rejected_rules_file(spark, d):
    """Rejected rules, written and read strictly; who rejected one may be unknown."""
    r = _rules(spark, d).select("type", F.array("id", "n").alias("supporting_cases"), F.when(F.col("n") > 3, "teacher").alias("rejected_by"), F.lit("2031-01-01T00:00:00Z").alias("rejected_at"), F.col("description").alias("reason"))
    got = jsonl.read_rejected_rules(spark, _file(spark, r, ["reason"]))
    return got.select("type", F.col("supporting_cases")[0].alias("first_case"), F.col("supporting_cases")[1].alias("second_case"), "rejected_by", "reason")


@query("SELECT doc_id AS id, source, heading, text AS content FROM documents")
def digest_file(spark, d):
    """Documents as a digest store, written and read."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "heading", F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit("2031-01-01").alias("digested_at"))
    return jsonl.read_digest(spark, _file(spark, docs, ["id"])).select("id", "source", "heading", "content")


@query("SELECT 'good' AS file, count(*) AS n FROM cases UNION ALL SELECT 'bad', 0")
def lenient_files(spark, d):
    """Rows of the case base read leniently, and of the same with one broken line."""
    c = _t(spark, d, "cases").select("id", "times_seen")
    good = _file(spark, c, ["id"])
    bad = f"{scratch(spark)}/rows"
    spark.read.text(good).union(spark.range(1).select(F.lit("{broken").alias("value"))).write.text(bad)
    ddl = "id BIGINT, times_seen BIGINT"
    return jsonl.read_lenient(spark, good, ddl).agg(F.lit("good").alias("file"), F.count("*").alias("n")).union(jsonl.read_lenient(spark, bad, ddl).agg(F.lit("bad").alias("file"), F.count("*").alias("n")))


@query("SELECT id - 1 AS id, signature AS title, CASE WHEN confirmed_by IS NULL THEN 'todo' ELSE 'done' END AS status, confirmed_by AS done_at FROM cases WHERE trim(signature) <> ''")
def tasks_file(spark, d):
    """Cases as tasks, written and read strictly."""
    c = _t(spark, d, "cases").where("trim(signature) <> ''")
    rows = c.select((F.col("id") - 1).alias("id"), F.col("signature").alias("title"), F.when(F.col("confirmed_by").isNull(), "todo").otherwise("done").alias("status"), F.col("last_seen").alias("created"), F.col("confirmed_by").alias("done_at"))
    return jsonl.read_tasks(spark, _file(spark, rows, ["id"])).select("id", "title", "status", "done_at")


@query(f"SELECT run::VARCHAR AS run_id, model, task, count(*) FILTER (WHERE success) * 2 >= count(*) AS success, max(iterations)::INT AS iterations FROM ({_RUN}) GROUP BY ALL")
def eval_run_files(spark, d):
    """Evaluation runs as one document a year, read as rows."""
    m = _runs(spark, d).groupBy("run", "model", "task").agg((F.count_if("success") * 2 >= F.count("*")).alias("success"), F.max("iterations").cast("int").alias("iterations"))
    by_task = m.groupBy("run", "model").agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct("success", "iterations")))).alias("r"))  # a few states
    runs = by_task.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("model", "r"))).alias("results"))  # a few priorities
    folder = f"{scratch(spark)}/runs"
    runs.select("run", F.to_json(F.struct(F.col("run").cast("string").alias("run_id"), F.lit("s").alias("started_at"), "results")).alias("value")).write.partitionBy("run").text(folder)  # a file a run
    return jsonl.read_eval_runs(spark, folder).select("run_id", "model", "task", "success", "iterations")


@query("SELECT id, to_json({'id': id, 'signature': signature, 'times_seen': times_seen, 'confirmed_by': confirmed_by, 'merged_from': merged_from})::VARCHAR AS line FROM cases")
def canonical_case_lines(spark, d):
    """Canonical line of every case."""
    c = _t(spark, d, "cases").select("id", "signature", "times_seen", "confirmed_by", "merged_from")
    return sinks.canonical_lines(c, ["id"]).select(F.get_json_object("line", "$.id").cast("bigint").alias("id"), "line")


# ---- text scans ------------------------------------------------------------------------------------------------------


@query(rf"SELECT ts, text FROM (SELECT recorded_at AS ts, regexp_extract(goal, '^([^\r\n]*)', 1) AS text FROM ({_ONCE_E}) WHERE goal IS NOT NULL)")
def journal_lines(spark, d):
    """Goals as journal entries, read back; other lines are no entries."""
    e = _e(spark, d).where("goal IS NOT NULL")
    own = e.select(F.concat(F.lit("## "), "recorded_at", F.lit(" "), F.regexp_extract("goal", r"^([^\r\n]*)", 1)).alias("line"))
    return T.journal_entries(own.union(e.select(F.col("goal").alias("line"))))


_FIXES = rf"SELECT substr(experience_id, 1, 12) AS commit, {_STRIP.format('goal')} AS subject FROM ({_ONCE_E}) WHERE regexp_matches({_STRIP.format('goal')}, '{T.FIX_SUBJECT}') AND NOT regexp_matches({_STRIP.format('goal')}, '[\r\n]')"


def _commits(spark, d):
    goal = X.strip(F.col("goal"))
    return _e(spark, d).where(~goal.rlike(r"[\r\n]")).select(F.concat(F.substring("experience_id", 1, 12), F.lit(" "), goal).alias("line"))


@query(
    f"SELECT commit, {_sql_canonical(_STRIP.format(f'regexp_replace(subject, {chr(39)}{T.FIX_SUBJECT}{chr(39)}, {chr(39) * 2})') + ' || ' + chr(39) + ' :: fixed in ' + chr(39) + ' || commit')} AS signature, subject AS error_excerpt, 'Fixed in commit ' || commit || ': ' || subject AS diagnosis FROM ({_FIXES})"
)
def commit_cases(spark, d):
    """Cases mined from a commit log of goals."""
    return T.commit_cases(_commits(spark, d))


_MINED = " UNION ALL ".join(
    f"SELECT {k} AS s, {key}::VARCHAR AS k, {pos}::VARCHAR AS p, signature, error_excerpt, diagnosis FROM ({ORACLES[name]})" for k, (name, key, pos) in enumerate((("decision_cases", "doc_id", "pos"), ("commit_cases", "commit", "0"), ("transcript_cases", "experience_id", "pos")))
)


@query(f"SELECT 0::BIGINT AS id, signature, error_excerpt, diagnosis, 1::BIGINT AS times_seen, '{T.MINED['last_seen']}' AS last_seen, '{T.MINED['confirmed_by']}' AS confirmed_by FROM ({_MINED}) QUALIFY row_number() OVER (PARTITION BY signature ORDER BY s, k, p) = 1")
def mined_archive(spark, d):
    """Cases of decision logs, commits and transcripts, the first of every signature, as rows of a case base."""
    logs = T.decision_cases(_t(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "k")
    commits = T.commit_cases(_commits(spark, d)).withColumnRenamed("commit", "k").withColumn("pos", F.lit(0))
    talks = T.transcript_cases(_e(spark, d), "experience_id", "failure").withColumnRenamed("experience_id", "k")
    return T.exported(T.mined({"decisions": logs, "commits": commits, "transcripts": talks}, ["k", "pos"]))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\n'), 1) AS line_no FROM documents) SELECT doc_id, line_no, substr(line, 1, 200) AS line FROM l WHERE contains(lower(line), 'timeout') ORDER BY doc_id, line_no LIMIT 100")
def grep_documents(spark, d):
    """The first hundred lines of documents about timeouts."""
    return T.grep_lines(_t(spark, d, "documents"), "doc_id", "text", "timeout").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\n'), 1) AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE line_no BETWEEN 2 AND 4")
def line_windows(spark, d):
    """Lines 2 to 4 of every document."""
    return T.line_window(_t(spark, d, "documents"), "doc_id", "text", 2, 3).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"""SELECT DISTINCT substr(upper(verdict), 1, 1) AS "index", 'M' AS tree, actions[1] AS path, source AS origin FROM ({_ONCE_T}) WHERE len(actions) > 0 AND source IS NOT NULL""")
def porcelain_entries(spark, d):
    """Entries of a status listing made of trajectories."""
    t = _tr(spark, d).where("size(actions) > 0 AND source IS NOT NULL")
    rows = t.select(F.concat(F.substring(F.upper("verdict"), 1, 1), F.lit("M "), "source", F.lit(' -> "'), F.col("actions")[0], F.lit('"')).alias("line"))
    return T.porcelain_status(rows.union(t.limit(0).select(F.lit("## x").alias("line")))).distinct()


@query("SELECT n_name AS branch, false AS detached, n_nationkey::INT AS ahead, n_regionkey::INT AS behind FROM nation")
def branch_headers(spark, d):
    """Branch lines made of nations."""
    rows = _t(spark, d, "nation").select(F.concat(F.lit("## "), "n_name", F.lit("...origin/x [ahead "), "n_nationkey", F.lit(", behind "), "n_regionkey", F.lit("]")).alias("line"))
    return T.branch_header(rows)


@query(f"SELECT experience_id AS commit, outcome AS author, recorded_at AS date, regexp_replace(goal, '\\s+', ' ', 'g') AS subject, coalesce(session_id, '') AS refs FROM ({_ONCE_E}) WHERE goal IS NOT NULL")
def commit_log(spark, d):
    """A log with unit separators made of experiences."""
    rows = _e(spark, d).where("goal IS NOT NULL").select(F.concat_ws("\x1f", "experience_id", "outcome", "recorded_at", F.regexp_replace("goal", r"\s+", " "), F.coalesce("session_id", F.lit(""))).alias("line"))
    return T.numbered_log(rows.union(rows.select(F.lit("x").alias("line"))))


_ERRORS = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(failure, '{p}') THEN {_STRIP.format(f'regexp_extract(failure, {chr(39)}{p}{chr(39)}, 1)')} END" for p in T.ERROR_LINES) + ")"


@query(f"SELECT experience_id, {_ERRORS} AS excerpt FROM ({_ONCE_E}) WHERE failure IS NOT NULL")
def error_excerpts(spark, d):
    """What patterns of error lines find in failures."""
    return _e(spark, d).where("failure IS NOT NULL").select("experience_id", T.error_excerpt(F.col("failure")).alias("excerpt"))


# ---- sessions --------------------------------------------------------------------------------------------------------


def _store(spark, d):
    """Session, message and part tables made of trajectories: a session for each, its goal as user text, its steps as tool parts."""
    t = _tr(spark, d).where("session_id IS NOT NULL")
    key = F.concat(F.lit("m"), F.col("traj_id").cast("string"))
    session = t.select(F.col("session_id").alias("id"), F.lit("/work").alias("directory")).distinct()
    message = t.select(key.alias("id"), "session_id", F.lit('{"role": "user"}').alias("data"))
    said = t.select(F.concat(F.lit("p"), F.col("traj_id")).alias("id"), key.alias("message_id"), "session_id", (F.col("traj_id") * 100).alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("goal").alias("text"))).alias("data"))
    s = t.select("traj_id", key.alias("message_id"), "session_id", F.posexplode("steps").alias("k", "s"))
    used = s.select(F.concat(F.lit("q"), F.col("traj_id"), F.lit("-"), F.col("k")).alias("id"), "message_id", "session_id", (F.col("traj_id") * 100 + F.col("k") + 1).alias("time_created"), F.to_json(F.struct(F.lit("tool").alias("type"), F.col("s.tool").alias("tool"))).alias("data"))
    return session, message, said.union(used)


_SESSION = f"WITH t AS (SELECT * FROM ({_ONCE_T}) WHERE session_id IS NOT NULL)"


@query(f"{_SESSION} SELECT session_id AS id, count(*) AS message_count, (count(*) + sum(len(steps)))::BIGINT AS part_count FROM t GROUP BY 1")
def session_volumes(spark, d):
    """Messages and parts of every session."""
    return sessions.session_volume(*_store(spark, d))


_SHORT = r"CASE WHEN length({0}) <= 200 THEN {0} ELSE regexp_replace(regexp_replace(substr({0}, 1, 200), '\s?[^\s]*$', ''), '[,;:]+$', '') || '…' END"


@query(f"{_SESSION}, g AS (SELECT session_id, {_STRIP.format('goal')} AS g FROM t WHERE length({_STRIP.format('goal')}) > 0 AND lower({_STRIP.format('goal')}) NOT IN ('continue', 'continue.', 'go on', 'keep going', 'resume') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY traj_id) = 1) SELECT session_id, {_SHORT.format('g')} AS goal FROM g")
def session_goals(spark, d):
    """Goal of every session: its first user text that says something, shortened at a word."""
    _, message, part = _store(spark, d)
    return sessions.first_goal(sessions.parts_with_role(message, part))


@query(f"{_SESSION}, s AS (SELECT session_id, unnest(steps).tool AS tool, traj_id * 100 + generate_subscripts(steps, 1) AS o FROM t) SELECT session_id, string_agg(tool, ',' ORDER BY o) FILTER (WHERE k <= 50) AS actions, count(*) AS tool_count FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS k FROM s) GROUP BY 1")
def session_actions(spark, d):
    """First tools of every session in order, and their number."""
    _, message, part = _store(spark, d)
    return sessions.tool_actions(sessions.parts_with_role(message, part)).select("session_id", F.array_join("actions", ",").alias("actions"), "tool_count")


@query(
    f"{_SESSION}, g AS (SELECT session_id, {_STRIP.format('goal')} AS g FROM t WHERE length({_STRIP.format('goal')}) > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY traj_id) = 1), v AS (SELECT session_id, count(*) AS m, (count(*) + sum(len(steps)))::BIGINT AS p, sum(len(steps))::BIGINT AS n FROM t GROUP BY 1) "
    f"SELECT substr(sha256('mine:' || session_id), 1, 32) AS experience_id, session_id, coalesce({_SHORT.format('g')}, 'continued prior work in /work') AS goal, m AS message_count, p AS part_count, n AS tool_count, 0.3::DOUBLE AS confidence FROM v LEFT JOIN g USING (session_id) WHERE g IS NOT NULL OR p >= 100"
)
def mined_sessions(spark, d):
    """Sessions as mined experiences."""
    session, message, part = _store(spark, d)
    parts = sessions.parts_with_role(message, part)
    e = sessions.as_experiences(session, sessions.session_volume(session, message, part), sessions.first_goal(parts), sessions.tool_actions(parts), "mine")
    return e.select("experience_id", "session_id", "goal", "message_count", "part_count", "tool_count", "confidence")


@query(f"{_SESSION} SELECT directory, count(*) AS seen, count(*) FILTER (WHERE n >= 3) AS mined FROM (SELECT '/work' AS directory, session_id, sum(len(steps)) AS n FROM t GROUP BY 1, 2) GROUP BY ROLLUP (directory)")
def mining_stats(spark, d):
    """Sessions seen and mined of every directory, with the total."""
    session, _, part = _store(spark, d)
    busy = part.where(F.get_json_object("data", "$.tool").isNotNull()).groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 3").select("session_id")
    return sessions.mine_stats(session, busy)


@query(f"SELECT traj_id AS session_id, count(*) AS parts, count(*) FILTER (WHERE role = 'user') AS said, min(role) AS first_role FROM (SELECT traj_id, 'user' AS role FROM ({_ONCE_T}) UNION ALL SELECT traj_id, 'assistant' FROM (SELECT traj_id, unnest(steps) FROM ({_ONCE_T}))) GROUP BY 1")
def transcript_parts(spark, d):
    """Parts of JSON transcripts made of trajectories."""
    t = _tr(spark, d)
    user = F.array(F.struct(F.struct(F.lit("user").alias("role")).alias("info"), F.array(F.struct(F.col("goal").alias("text"), F.lit(None).cast("string").alias("tool"))).alias("parts")))
    tools = F.transform("steps", lambda s: F.struct(F.struct(F.lit("assistant").alias("role")).alias("info"), F.array(F.struct(F.lit(None).cast("string").alias("text"), s["tool"].alias("tool"))).alias("parts")))
    rows = t.select(F.col("traj_id").alias("session_id"), F.to_json(F.concat(user, tools)).alias("transcript"))
    p = sessions.transcript_parts(rows)
    return p.groupBy("session_id").agg(F.count("*").alias("parts"), F.count_if(F.col("role") == "user").alias("said"), F.min("role").alias("first_role"))


# ---- text functions --------------------------------------------------------------------------------------------------


@query(f"SELECT experience_id, {_SHORT.format('diagnosis').replace('200', '60')} AS short, CASE WHEN regexp_matches(w, '^[a-z]') THEN w ELSE 'skill_' || w END AS slug FROM (SELECT *, array_to_string(regexp_extract_all(lower(diagnosis), '[a-z0-9]+')[1:5], '_') AS w FROM ({_ONCE_E}) WHERE diagnosis IS NOT NULL)")
def short_texts(spark, d):
    """Diagnoses shortened at a word, and as names of skills."""
    c = F.col("diagnosis")
    return _e(spark, d).where("diagnosis IS NOT NULL").select("experience_id", X.shorten(c, 60).alias("short"), X.slug(c).alias("slug"))


@query(f"SELECT traj_id, regexp_replace(final_answer, '(?mi)^(system|user|assistant|tool):', ' \\1:', 'g') AS escaped FROM ({_ONCE_T}) WHERE final_answer IS NOT NULL UNION ALL SELECT -doc_id - 1, regexp_replace(text, '(?mi)^(system|user|assistant|tool):', ' \\1:', 'g') FROM documents WHERE text IS NOT NULL")
def escaped_roles(spark, d):
    """Answers and documents whose lines can't be taken for turns."""
    a = _tr(spark, d).where("final_answer IS NOT NULL").select("traj_id", X.escape_roles(F.col("final_answer")).alias("escaped"))
    return a.union(_t(spark, d, "documents").where("text IS NOT NULL").select(-F.col("doc_id") - 1, X.escape_roles(F.col("text"))))


@query("SELECT id, strftime(make_timestamp(epoch_us(" + "try_strptime(substr(last_seen, 1, 19), '%Y-%m-%dT%H:%M:%S')) - CASE WHEN regexp_matches(last_seen, '[+-]\\d\\d:\\d\\d$') THEN (CASE WHEN substr(last_seen, -6, 1) = '-' THEN -1 ELSE 1 END) * (substr(last_seen, -5, 2)::BIGINT * 60 + substr(last_seen, -2, 2)::BIGINT) * 60000000 ELSE 0 END), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM cases")
def utc_stamps(spark, d):
    """Sightings as stamps in UTC."""
    return _t(spark, d, "cases").select("id", X.utc_stamp(X.parse_stamp(F.col("last_seen"))).alias("stamp"))


@query(r"SELECT id, array_to_string(list_transform(string_split(nullif(regexp_extract(error_excerpt, '(\d+(?:\.\d+)+|\d{1,6})', 1), ''), '.'), lambda x: x::INT), '.') AS version FROM cases")
def version_numbers(spark, d):
    """First number with or without dots of every excerpt."""
    e = F.regexp_extract("error_excerpt", r"(\d+(?:\.\d+)+|\d{1,6})", 1)
    return _t(spark, d, "cases").select("id", F.array_join(F.transform(X.version_tuple(F.nullif(e, F.lit(""))), lambda x: x.cast("string")), ".").alias("version"))


@query("SELECT doc_id, octet_length(encode(text)) > 200 AS cut, starts_with(text, kept) AND octet_length(encode(kept)) <= 200 AS fits FROM (SELECT doc_id, text, substr(text, 1, 50) AS kept FROM documents WHERE text IS NOT NULL)")
def byte_caps(spark, d):
    """Documents within 200 bytes: whether they were cut, and whether what is left begins them."""
    kept, cut = X.byte_cap(F.col("text"), 200)
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", cut.alias("cut"), (F.col("text").startswith(kept) & (F.octet_length(kept) <= 200)).alias("fits"))


_LINES = r"string_split_regex(text, '\r\n|[\n\r]')"


@query(f"SELECT doc_id, CASE WHEN len({_LINES}) <= 15 THEN text ELSE array_to_string({_LINES}[1:5], chr(10)) || chr(10) || '... ' || (len({_LINES}) - 15) || ' lines omitted ...' || chr(10) || array_to_string({_LINES}[-10:], chr(10)) END AS shown FROM documents WHERE text IS NOT NULL")
def head_tails(spark, d):
    """First and last lines of every document."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.head_tail(F.col("text")).alias("shown"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^(?:FAIL|ERROR)') THEN regexp_extract(text, '(?m)^((?:FAIL|ERROR)[^\\r\\n]*)', 1) ELSE nullif(rtrim(regexp_extract(text, '([^ \\t\\f\\v\\r\\n][^\\r\\n]*)[ \\t\\f\\v\\r\\n]*$', 1), ' ' || chr(9) || chr(11) || chr(12)), '') END AS line FROM documents WHERE text IS NOT NULL")
def error_lines(spark, d):
    """The line of every document that tells of an error, or its last one."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.error_line(F.col("text")).alias("line"))


def _redacted(c: str) -> str:
    for _, p in X.CREDENTIALS:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@query(f"SELECT experience_id, {_redacted('failure')} AS failure, {_redacted('resolution')} AS resolution, array_to_string(tags, ',') AS tags FROM ({_ONCE_E})")
def redacted_records(spark, d):
    """Records with credentials replaced in all their texts."""
    return sinks.redacted(_e(spark, d).select("experience_id", "failure", "resolution", "tags")).select("experience_id", "failure", "resolution", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT experience_id, CASE WHEN lower({_STRIP.format('goal')}) IN ('continue', 'continue.', 'go on', 'keep going', 'resume') THEN 'continuation' ELSE 'greeting' END AS rule FROM ({_ONCE_E}) WHERE lower({_STRIP.format('goal')}) IN ('continue', 'continue.', 'go on', 'keep going', 'resume') OR regexp_matches(coalesce(goal, ''), '^[^\\p{{L}}\\p{{N}}_]*$')")
def hygiene(spark, d):
    """Records that a cleanup removes: goals that only continue, greet or say nothing."""
    return C.hygiene(_e(spark, d), "goal", "experience_id")


@query("SELECT id, regexp_matches(trim(error_excerpt), '^[0-9a-fA-F]{7,64}$') AS hash FROM cases WHERE error_excerpt IS NOT NULL UNION ALL SELECT -1, count(*) = count(*) FILTER (WHERE regexp_matches(experience_id, '^[0-9a-fA-F]{7,64}$')) FROM experiences")
def hash_queries(spark, d):
    """Excerpts that are nothing but a hash, and whether all ids are."""
    c = _t(spark, d, "cases").where("error_excerpt IS NOT NULL").select("id", C.is_hash_query(F.col("error_excerpt")).alias("hash"))
    return c.union(_t(spark, d, "experiences").agg(F.lit(-1).cast("bigint"), F.bool_and(C.is_hash_query(F.col("experience_id")))))


_URL = r"regexp_extract(text, '(https?://[^\s<>\x22\x27)\]]+)', 1)"
_HOST = r"lower(regexp_extract(u, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(rf"SELECT doc_id, regexp_matches(u, '(?i)^https?://') AND (p = '' OR p IN ('80', '443')) AND NOT regexp_matches({_HOST}, '^(?:localhost$|.*\.local$|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.)') AS allowed FROM (SELECT doc_id, u, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*?:(\d+)(?:[/?#]|$)', 1) AS p FROM (SELECT doc_id, {_URL} AS u FROM documents) WHERE u <> '')")
def url_policy(spark, d):
    """Whether the first address of every document may be fetched."""
    u = _t(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(https?://[^\s<>\x22\x27)\]]+)", 1).alias("u")).where("u <> ''")
    return u.select("doc_id", C.url_allowed(F.col("u")).alias("allowed"))


# ---- sequences and stores --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b")
def falling_values(spark, d):
    """Events whose value isn't above the one before of their user."""
    return S.strictly_rising(_t(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id")


@query(
    f"""WITH RECURSIVE s AS (SELECT traj_id, [coalesce(x.ok, false) FOR x IN steps] AS l FROM ({_ONCE_T})), f AS (SELECT traj_id, l, 0 AS k, 1 AS level, 0 AS good, 0 AS bad FROM s UNION ALL
    SELECT traj_id, l, k + 1, CASE WHEN l[k + 1] AND good + 1 >= 2 THEN least(level + 1, 8) WHEN NOT l[k + 1] AND bad + 1 >= 2 THEN greatest(level - 1, 1) ELSE level END, CASE WHEN l[k + 1] AND good + 1 < 2 THEN good + 1 ELSE 0 END, CASE WHEN NOT l[k + 1] AND bad + 1 < 2 THEN bad + 1 ELSE 0 END FROM f WHERE k < len(l))
    SELECT traj_id, level FROM f WHERE k = len(l)"""
)
def adaptive_levels(spark, d):
    """Level that every trajectory's steps lead to."""
    ok = F.transform("steps", lambda s: F.coalesce(s["ok"], F.lit(False)))
    return _tr(spark, d).select("traj_id", S.adaptive_level(ok, 2, 2).alias("level"))


@query(f"SELECT experience_id, len(l) >= 2 AND l[-1] = 0 AND list_contains(list_transform(l, lambda x: x <> 0), true) AS proved FROM (SELECT experience_id, list_transform(verification.attempts, lambda a: CASE WHEN a.ok THEN 0 ELSE 1 END) AS l FROM ({_ONCE_E})) WHERE len(l) > 0")
def proved_by_tests(spark, d):
    """Verifications that failed at first and passed at last."""
    codes = F.transform("verification.attempts", lambda a: F.when(a["ok"], 0).otherwise(1))
    return _e(spark, d).where(F.size("verification.attempts") > 0).select("experience_id", S.proved_by_tests_in(codes, 2).alias("proved"))


_MOVES = "(SELECT unnest(actions[:-2]) AS a, unnest(actions[2:]) AS b, unnest(generate_series(1, len(actions) - 1)) AS i)"


@query(f"SELECT traj_id, (SELECT count(*) FROM {_MOVES} x JOIN {_MOVES} y ON x.i < y.i AND x.a = y.b AND x.b = y.a AND x.a <> x.b) > 0 AS back FROM ({_ONCE_T}) WHERE len(actions) >= 2")
def reverted_moves(spark, d):
    """Trajectories that go from one action to another and later straight back."""
    n = F.size("actions")
    moves = F.zip_with(F.slice("actions", F.lit(1), n - 1), F.slice("actions", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return _tr(spark, d).where(n >= 2).select("traj_id", S.reverted_in(moves).alias("back"))


@query(f"SELECT session_id, substr(regexp_extract(failure, '^\\s*([^\\r\\n]*)', 1), 1, 300) AS failure FROM ({_ONCE_E}) WHERE length(failure) > 0 AND session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY experience_id) = 1")
def first_failures(spark, d):
    """First failure of every session."""
    return C.first_failure(_e(spark, d).where("session_id IS NOT NULL"), "session_id", [F.col("experience_id")], "failure")


@query("SELECT event_id, user_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE seq > n - 20")
def late_history(spark, d):
    """The last twenty events that a late subscriber of a user gets."""
    e = stores.numbered_events(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    return stores.history(e, "user_id", 20).select("event_id", "user_id", F.col("seq").cast("bigint").alias("seq"))


@query("WITH s AS (SELECT DISTINCT signature AS k, 1 AS scan, max(times_seen) OVER (PARTITION BY signature) AS h FROM cases WHERE signature IS NOT NULL), f AS (SELECT DISTINCT signature AS k, 2 AS scan, max(times_passed) OVER (PARTITION BY signature) AS h FROM flakes WHERE signature IS NOT NULL) SELECT coalesce(s.k, f.k) AS signature, 2 AS scan, CASE WHEN s.k IS NULL THEN 'new' WHEN f.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM s FULL JOIN f ON s.k = f.k WHERE s.k IS NULL OR f.k IS NULL OR s.h <> f.h")
def change_feed(spark, d):
    """Changes from the signatures of cases to those of passes, as two scans."""
    fold = lambda t, c, n: _t(spark, d, t).where("signature IS NOT NULL").groupBy("signature").agg(F.max(c).cast("string").alias("h")).withColumn("scan", F.lit(n))
    return stores.change_feed(fold("cases", "times_seen", 1).union(fold("flakes", "times_passed", 2)), "signature", "h", "scan")


@query("SELECT signature AS key, id, error_excerpt FROM cases WHERE signature IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY length(error_excerpt) DESC NULLS LAST, id) = 1")
def longest_excerpts(spark, d):
    """The longest excerpt of every signature."""
    c = _t(spark, d, "cases").where("signature IS NOT NULL").select("id", "signature", "error_excerpt")
    return A.longest_per_key(c, F.col("signature"), "error_excerpt", [F.asc("id")]).select("key", "id", "error_excerpt")


@query("WITH r AS (SELECT p_brand AS name, max(p_size) AS v FROM part GROUP BY 1), f AS (SELECT p_brand AS name, min(p_size) AS v FROM part WHERE p_size > 1 GROUP BY 1) SELECT r.name, r.v::VARCHAR || '.0' AS required, f.v::VARCHAR AS found, CASE WHEN f.v IS NULL THEN 'missing' WHEN f.v < r.v THEN 'mismatch' ELSE 'ok' END AS status FROM r LEFT JOIN f USING (name)")
def requirement_status(spark, d):
    """Versions that brands need against those that they have."""
    p = _t(spark, d, "part")
    need = p.groupBy(F.col("p_brand").alias("name")).agg(F.concat(F.max("p_size").cast("string"), F.lit(".0")).alias("version"))
    have = p.where("p_size > 1").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").cast("string").alias("version"))
    return C.requirements(need, have)


@query(f"WITH s AS (SELECT sha256({_STRIP.format('text')}) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT DISTINCT sha256({_STRIP.format('text')}) AS h FROM documents WHERE text IS NOT NULL AND lang = 'en') SELECT count(DISTINCT s.h) AS sections, count(DISTINCT a.h) AS known, count(DISTINCT s.h) - count(DISTINCT a.h) AS added FROM s LEFT JOIN a USING (h)")
def digest_upsert(spark, d):
    """Digest store after documents of all languages come to those in English: sections, known and new ones; ids are all different."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("heading", F.lit("")).alias("heading"), F.col("text").alias("content"), F.lit("now").alias("digested_at"), "lang", "doc_id")
    live = docs.where("lang = 'en'").withColumn("content_hash", X.content_hash(F.col("content"))).groupBy("content_hash").agg(F.min(F.struct("doc_id", "source", "heading", "content")).alias("r"))
    live = live.select(F.col("r.doc_id").alias("id"), "r.source", "r.heading", "r.content", "content_hash", F.lit("old").alias("digested_at"))
    out = sinks.merge_digest(live, docs.drop("lang", "doc_id"))
    n = live.count()
    last = live.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return out.agg(F.count_distinct("content_hash").alias("sections"), F.count_if(F.col("id") <= last).alias("known"), (F.count_distinct("id") - n).alias("added"))
