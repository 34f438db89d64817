"""Queries of the operators on records of trajectories and messages, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import messages as M
from casewright.operators import records as O
from casewright.operators import relational as R
from casewright.queries.core import _ONCE_E, _ONCE_T, _RUN, _once, _runs, _sql_canonical, _sql_goal, _sql_norm, _t, query

SYSTEM = "You call tools as [TOOL: name(key=\"value\")]."
_PLAIN = r"regexp_replace(coalesce(goal, ''), '\s*\(benchmark run [0-9a-f]{8}\)$', '')"
_FAILED = "len(list_filter(steps, lambda s: s.ok = false))"
_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _trajectories(spark, d):
    return _once(_t(spark, d, "trajectories"), "traj_id")


def _experiences(spark, d):
    return _once(_t(spark, d, "experiences"), "experience_id")


@query(
    f"""SELECT traj_id, CASE WHEN {_FAILED} > 1 THEN 'REJECT' WHEN truncated THEN 'REVIEW' WHEN outcome = 'success' AND provenance.experience_id IS NULL THEN 'REVIEW' WHEN provenance.overall_score >= 0.6 THEN 'ACCEPT'
    WHEN provenance.overall_score >= 0.3 THEN 'REVIEW' ELSE 'REJECT' END AS decided, CASE WHEN {_FAILED} > 1 THEN 'failed steps' WHEN truncated THEN 'truncated' WHEN outcome = 'success' AND provenance.experience_id IS NULL THEN 'no provenance'
    WHEN provenance.overall_score >= 0.6 THEN 'score' WHEN provenance.overall_score >= 0.3 THEN 'middling score' ELSE 'low or no score' END AS reason FROM ({_ONCE_T})"""
)
def decided_verdicts(spark, d):
    """Verdict of an ordered list of rules for every trajectory, with the reason of the rule that decided."""
    score = F.col("provenance.overall_score")
    rules = [(O.failed_steps(F.col("steps")) > 1, "REJECT", "failed steps"), (F.col("truncated"), "REVIEW", "truncated"), ((F.col("outcome") == "success") & F.col("provenance.experience_id").isNull(), "REVIEW", "no provenance")]
    rules += [(score >= 0.6, "ACCEPT", "score"), (score >= 0.3, "REVIEW", "middling score")]
    value, reason = O.first_decision(rules, ("REJECT", "low or no score"))
    return _trajectories(spark, d).select("traj_id", value.alias("decided"), reason.alias("reason"))


@query(
    f"""WITH r AS (SELECT traj_id, [CASE WHEN list_contains(tags, 'flaky') THEN 'marked' END, CASE WHEN verdict <> 'ACCEPT' THEN 'verdict ' || verdict END, CASE WHEN trajectory_class NOT IN ('successful', 'recovered') THEN 'class ' || trajectory_class END,
    CASE WHEN provenance.experience_id IS NULL THEN 'no evidence' END, CASE WHEN {_FAILED} > 2 AND NOT list_contains(tags, 'demo') THEN {_FAILED}::VARCHAR || ' failed steps' END] AS l FROM ({_ONCE_T})),
    f AS (SELECT traj_id, list_filter(l, lambda x: x IS NOT NULL) AS l FROM r)
    SELECT coalesce(reason, '(eligible)') AS reason, count(*) AS n FROM (SELECT traj_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS reason FROM f) GROUP BY 1"""
)
def exclusion_reasons(spark, d):
    """How often each reason keeps trajectories out; all reasons of a record count, those without any are eligible."""
    failed = O.failed_steps(F.col("steps"))
    rules = [
        (O.tagged_any(F.col("tags"), ["flaky"]), "marked"), (F.col("verdict") != "ACCEPT", F.concat(F.lit("verdict "), "verdict")), (~F.col("trajectory_class").isin("successful", "recovered"), F.concat(F.lit("class "), "trajectory_class")),
        (F.col("provenance.experience_id").isNull(), "no evidence"), ((failed > 2) & ~O.tagged_any(F.col("tags"), ["demo"]), F.concat(failed.cast("string"), F.lit(" failed steps"))),
    ]
    rows = _trajectories(spark, d).select(F.explode_outer(O.all_reasons(rules)).alias("reason"))
    return rows.groupBy(F.coalesce("reason", F.lit("(eligible)")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT traj_id, CASE trajectory_class WHEN 'successful' THEN 'done' WHEN 'recovered' THEN 'repaired' ELSE 'open' END AS kind, len(actions) AS actions, least(len(steps), 3) AS kept, len(steps) > 3 AS cut,
    len(steps) > 0 AND len(list_filter(steps, lambda s: s.args IS NULL OR NOT starts_with(s.args, '{{'))) = 0 AS trainable, coalesce(tags[2], tags[1], 'unknown') AS tag, provenance.experience_id AS experience_id FROM ({_ONCE_T}) WHERE trajectory_class <> 'failed'"""
)
def record_projection(spark, d):
    """Curated trajectories as records: class by a map, steps up to a cap, what was cut, whether steps can be taught, tag and origin; failed ones stay out."""
    t = _trajectories(spark, d).where("trajectory_class <> 'failed'")
    kind = O.mapped(F.col("trajectory_class"), {"successful": "done", "recovered": "repaired"}, "open")
    return t.select("traj_id", kind.alias("kind"), F.size("actions").cast("bigint").alias("actions"), F.size(F.slice("steps", 1, 3)).cast("bigint").alias("kept"), (F.size("steps") > 3).alias("cut"), O.trainable(F.col("steps")).alias("trainable"), O.project_tag(F.col("tags")).alias("tag"), F.col("provenance.experience_id").alias("experience_id"))


@query(
    f"""WITH f AS (SELECT experience_id, list_filter(verification.attempts, lambda a: NOT coalesce(a.ok, false))[1:3] AS l FROM ({_ONCE_E}))
    SELECT experience_id, unnest(generate_series(1, len(l))) AS pos, unnest(l).detail AS detail, unnest(l).after_step AS after_step FROM f"""
)
def after_steps(spark, d):
    """The first three failures of every verification, with the steps that their attempts name."""
    e = _experiences(spark, d).select("experience_id", F.col("verification.attempts").alias("a"))
    failures = F.transform(F.filter("a", lambda a: ~F.coalesce(a["ok"], F.lit(False))), lambda a: F.struct(a["detail"].alias("detail"), F.lit(None).cast("int").alias("after_step")))
    rows = e.select("experience_id", F.posexplode(O.with_after_steps(failures, F.col("a"))).alias("k", "f"))
    return rows.select("experience_id", (F.col("k") + 1).cast("bigint").alias("pos"), "f.detail", "f.after_step")


@query(
    f"""WITH a AS (SELECT traj_id, unnest(actions) AS action, generate_subscripts(actions, 1) AS pos, steps FROM ({_ONCE_T}))
    SELECT traj_id, pos, '[TOOL: ' || action || '(' || CASE WHEN steps[pos].tool = action AND (steps[pos].args->>'$.path') IS NOT NULL THEN 'path="' || (steps[pos].args->>'$.path') || '"' ELSE '' END || ')]' AS call FROM a"""
)
def procedures(spark, d):
    """Actions of every trajectory as calls, with the arguments of the step in the same place where it has the same name."""
    rows = _trajectories(spark, d).select("traj_id", F.posexplode(O.procedure(F.col("actions"), F.col("steps"))).alias("k", "call"))
    return rows.select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), "call")


@query(
    f"""SELECT traj_id, array_to_string(CASE WHEN list_contains(tags, 'ci') AND NOT list_contains(tags, 'old') AND (NOT list_contains(tags, 'io') OR coalesce(steps[1].tool = 'read_file', false) AND NOT list_has_any(tags, ['demo', 'parser'])) THEN list_append(tags, 'old') ELSE tags END, ',') AS tags,
    list_contains(tags, 'ci') AND coalesce(list_filter(steps, lambda s: s.tool = 'read_file')[1].ok = false, false) AS guess FROM ({_ONCE_T})"""
)
def superseded_tags(spark, d):
    """Tags after records of one lane that are out of date are marked, and records whose first reading step failed."""
    tags, steps = F.col("tags"), F.col("steps")
    return _trajectories(spark, d).select("traj_id", F.array_join(O.superseded(tags, steps, "ci", "io", "old", ["demo", "parser"]), ",").alias("tags"), O.opening_guess(tags, steps, "ci", "old").alias("guess"))


_CHAT = f"""WITH t AS (SELECT traj_id, goal, steps, final_answer, coalesce(list_has_any(tags, ['demo']), false) AS deliberate, provenance.experience_id AS e FROM ({_ONCE_T})),
    v AS (SELECT experience_id AS e, list_filter(verification.attempts, lambda a: NOT coalesce(a.ok, false))[1:3] AS l FROM ({_ONCE_E})),
    s AS (SELECT traj_id, k, row_number() OVER (PARTITION BY traj_id ORDER BY k) AS r, s.tool AS tool, s.args AS args, s.ok AS ok, s.result_head AS head FROM (SELECT traj_id, deliberate, unnest(steps) AS s, generate_subscripts(steps, 1) AS k FROM t) WHERE deliberate OR coalesce(s.ok, true)),
    f AS (SELECT traj_id, n, f.detail AS detail, f.after_step AS after_step, len(steps) AS size FROM (SELECT traj_id, steps, unnest(l) AS f, generate_subscripts(l, 1) AS n FROM t JOIN v USING (e))),
    p AS (SELECT traj_id, n, detail, (SELECT count(*) FROM s WHERE s.traj_id = f.traj_id AND s.k <= f.after_step) AS spot FROM f WHERE after_step > 0 AND after_step <= size),
    g AS (SELECT *, coalesce(max(spot) OVER (PARTITION BY traj_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM p),
    m AS (SELECT traj_id, 0 AS a, 0 AS b, 'system' AS role, '{SYSTEM}' AS content FROM t UNION ALL SELECT traj_id, 0, 1, 'user', {_PLAIN} FROM t
    UNION ALL SELECT traj_id, r, 0, 'assistant', '[TOOL: ' || tool || '(path="' || (args->>'$.path') || '")]' FROM s UNION ALL SELECT traj_id, r, 1, 'user', substr(coalesce(nullif(head, ''), CASE WHEN ok THEN 'ok' ELSE 'no output captured' END), 1, 2000) FROM s
    UNION ALL SELECT traj_id, spot, 2, 'user', substr(coalesce(detail, ''), 1, 2000) FROM g WHERE spot > last
    UNION ALL SELECT traj_id, 1000000, 0, 'assistant', coalesce(nullif(final_answer, ''), 'Completed: ' || substr(coalesce(goal, ''), 1, 2000)) FROM t)"""


def _chats(spark, d):
    t = _trajectories(spark, d).withColumn("_e", F.col("provenance.experience_id"))
    e = _experiences(spark, d).select(F.col("experience_id").alias("_e"), F.col("verification.attempts").alias("_a"))
    both = t.join(e, "_e", "left")
    none = F.array().cast("array<struct<detail: string, after_step: int>>")
    failed = F.transform(F.filter("_a", lambda a: ~F.coalesce(a["ok"], F.lit(False))), lambda a: F.struct(a["detail"].alias("detail"), F.lit(None).cast("int").alias("after_step")))
    failures = F.coalesce(O.with_after_steps(failed, F.col("_a")), none)
    return both.select("traj_id", O.chat(SYSTEM, F.col("goal"), F.col("steps"), failures, F.col("final_answer"), O.tagged_any(F.col("tags"), ["demo"])).alias("messages"))


@query(f"{_CHAT} SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY a, b) AS pos, role, content FROM m")
def chat_messages(spark, d):
    """Chats of all trajectories: steps that failed stay out unless they are deliberate, refused answers stand where they were refused."""
    rows = _chats(spark, d).select("traj_id", F.posexplode("messages").alias("k", "m"))
    return rows.select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), "m.role", "m.content")


@query(
    f"""{_CHAT}, c AS (SELECT traj_id, a, b, role, regexp_replace(content, '(?mi)^(system|user|assistant|tool):', ' \\1:', 'g') AS esc, content FROM m)
    SELECT traj_id, string_agg(CASE WHEN role = 'system' THEN content ELSE role || ': ' || esc END, chr(10) || chr(10) ORDER BY a, b) AS prompt FROM c GROUP BY 1"""
)
def flat_prompts(spark, d):
    """Chats as one text each."""
    return _chats(spark, d).select("traj_id", M.flatten(F.col("messages")).alias("prompt"))


@query(
    f"""WITH s AS (SELECT traj_id, goal, unnest(steps) AS s, generate_subscripts(steps, 1) AS k FROM ({_ONCE_T}) WHERE trajectory_class = 'failed'),
    w AS (SELECT traj_id, min(k) AS w FROM s WHERE s.tool IN ('edit_file', 'write_file') GROUP BY 1), r AS (SELECT s.traj_id, max(k) AS r FROM s JOIN w USING (traj_id) WHERE k < w AND s.tool = 'read_file' GROUP BY 1),
    p AS (SELECT s.traj_id, any_value(goal) AS goal, count(*) AS length, count(*) FILTER (WHERE s.tool = 'read_file') AS reads FROM s JOIN r USING (traj_id) WHERE k <= r AND s.ok GROUP BY 1 HAVING count(*) >= 2)
    SELECT goal_key, traj_id, length, 2 + 2 * length AS messages FROM (SELECT lower({_TRIM.format(_PLAIN)}) AS goal_key, traj_id, length, row_number() OVER (PARTITION BY lower({_TRIM.format(_PLAIN)}) ORDER BY length DESC, traj_id) AS n FROM p) WHERE n = 1"""
)
def prefix_chats(spark, d):
    """What failed trajectories found out before their first write, the longest for each goal."""
    failed = _trajectories(spark, d).where("trajectory_class = 'failed'")
    return O.prefix_lane(failed, "traj_id", "goal", "steps", SYSTEM).select("goal_key", "traj_id", F.col("length").cast("bigint").alias("length"), F.size("messages").cast("bigint").alias("messages"))


@query(
    f"""SELECT 'cases' AS source, id::VARCHAR AS key, 'Diagnose this failure' AS instruction, 'Signature: ' || signature || chr(10) || 'Error: ' || error_excerpt AS input, diagnosis AS output FROM cases WHERE length({_TRIM.format('diagnosis')}) > 0 AND signature NOT IN (SELECT signature FROM holdout WHERE signature IS NOT NULL)
    UNION ALL SELECT 'documents', doc_id::VARCHAR, 'Answer based on documentation', 'Source: ' || coalesce(source, 'unknown') || chr(10) || 'Topic: ' || coalesce(heading, 'unknown'), text FROM documents WHERE length({_TRIM.format('text')}) > 0
    UNION ALL SELECT 'journal', experience_id, 'What lesson was learned?', 'Timestamp: ' || recorded_at, resolution FROM ({_ONCE_E}) WHERE length({_TRIM.format('resolution')}) > 0"""
)
def instruction_corpus(spark, d):
    """Instruction pairs of cases (without the held-out ones), documents and journal entries, in full."""
    cases = O.with_content(R.exclude(_t(spark, d, "cases"), "signature", _t(spark, d, "holdout"), "signature"), ["diagnosis"])
    docs, notes = O.with_content(_t(spark, d, "documents"), ["text"]), O.with_content(_experiences(spark, d), ["resolution"])
    line = lambda a, b, c, e: F.concat(F.lit(a), b, F.lit("\n" + c), e)
    one = cases.select(*O.pairs_of("cases", "Diagnose this failure", line("Signature: ", F.col("signature"), "Error: ", F.col("error_excerpt")), F.col("diagnosis"), F.col("id")))
    two = docs.select(*O.pairs_of("documents", "Answer based on documentation", line("Source: ", F.coalesce("source", F.lit("unknown")), "Topic: ", F.coalesce("heading", F.lit("unknown"))), F.col("text"), F.col("doc_id")))
    three = notes.select(*O.pairs_of("journal", "What lesson was learned?", F.concat(F.lit("Timestamp: "), "recorded_at"), F.col("resolution"), F.col("experience_id")))
    return one.union(two).union(three)


@query(
    f"""WITH f AS (SELECT DISTINCT signature AS command, split_part({_sql_canonical("split_part(signature, ' :: ', 1) || ' :: pass-probe'")}, ' :: ', 1) AS c FROM flakes WHERE signature IS NOT NULL)
    SELECT command, count(*) AS cases, sum(times_seen)::BIGINT AS seen FROM f JOIN cases ON split_part(cases.signature, ' :: ', 1) = c GROUP BY 1"""
)
def command_matches(spark, d):
    """Cases of the commands that passed: those whose signature begins with the command's key."""
    passes = _t(spark, d, "flakes").where("signature IS NOT NULL").select("signature", F.split("signature", " :: ")[0].alias("argv")).distinct()
    keys = passes.select("argv").distinct()
    found = O.match_by_command(_t(spark, d, "cases").select("signature", "times_seen"), keys, "argv").groupBy("argv").agg(F.count("*").alias("cases"), F.sum("times_seen").alias("seen"))
    return passes.join(found, "argv").select(F.col("signature").alias("command"), "cases", "seen")


@query(f"SELECT experience_id, {_sql_canonical("substr(goal, 1, 60) || ' :: ' || substr(failure, 1, 200)")} AS candidate FROM ({_ONCE_E}) WHERE failure IS NOT NULL AND goal IS NOT NULL")
def candidate_signatures(spark, d):
    """Signatures under which records with a failure could become cases."""
    return _experiences(spark, d).where("failure IS NOT NULL AND goal IS NOT NULL").select("experience_id", O.candidate_signature(F.col("goal"), F.col("failure")).alias("candidate"))


@query(f"SELECT traj_id, pos, tool, substr(head, 1, 20) AS head FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).result_head AS head, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))")
def bounded_results(spark, d):
    """Steps with the heads of their results cut."""
    s = _trajectories(spark, d).select("traj_id", F.posexplode("steps").alias("k", "s"))
    return s.select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), F.col("s.tool").alias("tool"), M.bounded(F.col("s.result_head"), 20).alias("head"))


@query(f"SELECT count(*) FILTER (WHERE outcome = 'human_corrected') = 0 AS no_preferences, count(*) FILTER (WHERE outcome = 'success' AND verification.ok) = 0 AS no_benchmarks, count(*) AS records FROM ({_ONCE_E})")
def curation_notes(spark, d):
    """Whether the exports of preferences and of benchmarks would be empty."""
    good = (F.col("outcome") == "success") & F.col("verification.ok")
    return _experiences(spark, d).agg((F.count_if(F.col("outcome") == "human_corrected") == 0).alias("no_preferences"), (F.count_if(good) == 0).alias("no_benchmarks"), F.count("*").alias("records"))


@query(f"SELECT model, task, count(*) FILTER (WHERE success) AS k, count(*) AS n, round(count(*) FILTER (WHERE success) / count(*), 4) AS rate, round(avg(iterations), 4) AS mean_iterations FROM ({_RUN}) GROUP BY 1, 2")
def success_rates(spark, d):
    """Successes of every model and task over all repetitions."""
    return _runs(spark, d).groupBy("model", "task").agg(F.count_if("success").alias("k"), F.count("*").alias("n"), F.round(F.count_if("success") / F.count("*"), 4).alias("rate"), F.round(F.avg("iterations"), 4).alias("mean_iterations"))


@query(f"SELECT source, count(*) AS sessions, count(*) FILTER (WHERE verdict = 'ACCEPT') AS accepted, count(*) FILTER (WHERE verdict = 'REJECT') AS rejected, count(DISTINCT capture_tier) AS modes FROM ({_ONCE_T}) GROUP BY 1")
def lab_report(spark, d):
    """Sessions, accepted and rejected ones of every source."""
    return _trajectories(spark, d).groupBy("source").agg(F.count("*").alias("sessions"), F.count_if(F.col("verdict") == "ACCEPT").alias("accepted"), F.count_if(F.col("verdict") == "REJECT").alias("rejected"), F.count_distinct("capture_tier").alias("modes"))


@query(f"SELECT capture_tier AS mode, count(*) AS sessions, count(*) FILTER (WHERE eligible) AS consensus, count(*) FILTER (WHERE NOT eligible) AS disagreement, array_to_string(list_sort(list(DISTINCT source)), ',') AS roles FROM ({_ONCE_T}) GROUP BY 1")
def mode_report(spark, d):
    """Sessions of every mode with their agreement and the roles seen (a few names)."""
    t = _trajectories(spark, d)
    return t.groupBy(F.col("capture_tier").alias("mode")).agg(F.count("*").alias("sessions"), F.count_if("eligible").alias("consensus"), F.count_if(~F.col("eligible")).alias("disagreement"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("roles"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, n, greatest((SELECT count(*) FROM g) - 10, 0) AS more FROM g ORDER BY n DESC, source LIMIT 10")
def shown_sources(spark, d):
    """The ten sources with most documents, and how many aren't shown."""
    g = _t(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return O.shown(g, [F.desc("n"), F.asc("source")])


@query("SELECT DISTINCT signature, times_seen FROM cases WHERE signature IS NOT NULL AND (signature, times_seen) NOT IN (SELECT signature, times_passed FROM flakes WHERE signature IS NOT NULL AND times_passed IS NOT NULL)")
def fresh_candidates(spark, d):
    """Distinct pairs of signature and count that the other log doesn't know."""
    known = _t(spark, d, "flakes").where("signature IS NOT NULL AND times_passed IS NOT NULL").select("signature", F.col("times_passed").alias("times_seen"))
    return O.new_candidates(_t(spark, d, "cases").where("signature IS NOT NULL").select("signature", "times_seen"), known, ["signature", "times_seen"])


@query(
    r"""WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n') AS l FROM documents), p AS (SELECT doc_id, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)cache')), true) AS a, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)error')), true) AS b FROM l)
    SELECT doc_id, CASE WHEN b IS NULL THEN 'SKIP' WHEN a IS NULL OR a > b THEN 'FAIL' ELSE 'PASS' END AS status FROM p"""
)
def line_order(spark, d):
    """Whether documents speak of a cache before they speak of an error, by lines."""
    return O.line_order(_t(spark, d, "documents"), "doc_id", "text", "(?i)cache", "(?i)error")


@query("SELECT id, signature AS path FROM cases WHERE signature IS NOT NULL")
def unquoted_paths(spark, d):
    """Texts that were quoted with octal escapes, as they were before."""
    octal = F.transform(F.regexp_extract_all(F.hex(F.encode("signature", "utf-8")), F.lit("(..)"), F.lit(1)), lambda h: F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0")))
    quoted = F.concat(F.lit('"'), F.array_join(octal, ""), F.lit('"'))
    return _t(spark, d, "cases").where("signature IS NOT NULL").select("id", quoted.alias("q")).select("id", M.unquote_path(F.col("q")).alias("path"))


@query(r"SELECT doc_id, CASE WHEN trim(coalesce(heading, '')) = '' THEN 'empty' WHEN regexp_matches(heading, '[/\\:]') THEN 'separator' WHEN regexp_matches(trim(heading), '^\.+$') THEN 'dots' END AS fault FROM documents")
def label_faults(spark, d):
    """Headings that can't be labels of files."""
    return _t(spark, d, "documents").select("doc_id", M.label_fault(F.col("heading")).alias("fault"))


@query(
    f"""SELECT experience_id, substr(concat_ws(chr(10) || chr(10), CASE WHEN length({_TRIM.format('goal')}) > 0 THEN 'Goal:' || chr(10) || {_TRIM.format('goal')} END, CASE WHEN length({_TRIM.format('failure')}) > 0 THEN 'Failure:' || chr(10) || {_TRIM.format('failure')} END,
    CASE WHEN length({_TRIM.format('diagnosis')}) > 0 THEN 'Diagnosis:' || chr(10) || {_TRIM.format('diagnosis')} END), 1, 300) AS prompt FROM ({_ONCE_E})"""
)
def prompts(spark, d):
    """Sections of every record as a prompt of bounded length."""
    return _experiences(spark, d).select("experience_id", M.prompt([("Goal", F.col("goal")), ("Failure", F.col("failure")), ("Diagnosis", F.col("diagnosis"))], 300).alias("prompt"))


@query("SELECT event_id, user_id, after FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after = 'signup'")
def state_faults(spark, d):
    """Events that follow a state which should be final."""
    return O.state_faults(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", ["signup"]).select("event_id", "user_id", "after")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 60 OR k <= 30")
def trimmed_trail(spark, d):
    """Events that stay when trails of more than sixty are cut to the last thirty."""
    return O.ring(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 30, 60).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def log_ring(spark, d):
    """The last five events of every user."""
    return O.ring(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query(f"SELECT traj_id, CASE WHEN capture_tier = 'behavior-trace' AND source = 'teacher' THEN 'large' WHEN len(steps) > 4 THEN 'long' WHEN inefficient THEN 'small' ELSE 'default' END AS route FROM ({_ONCE_T})")
def routes(spark, d):
    """First route whose rule fits each trajectory."""
    rules = [((F.col("capture_tier") == "behavior-trace") & (F.col("source") == "teacher"), "large", ""), (F.size("steps") > 4, "long", ""), (F.col("inefficient"), "small", "")]
    return _trajectories(spark, d).select("traj_id", O.first_decision(rules, ("default", ""))[0].alias("route"))


@query(r"SELECT lower(regexp_extract(source, '^([^/\\]+)[/\\]', 1)) AS root, count(*) AS files, count(DISTINCT lower(source)) AS paths FROM documents WHERE regexp_matches(source, '[/\\]') GROUP BY 1")
def distinct_roots(spark, d):
    """Roots of all sources, the same whatever the case, with their files."""
    s = _t(spark, d, "documents").where(F.col("source").rlike(r"[/\\]"))
    return s.groupBy(F.lower(F.regexp_extract("source", r"^([^/\\]+)[/\\]", 1)).alias("root")).agg(F.count("*").alias("files"), F.count_distinct(F.lower("source")).alias("paths"))


@query(
    f"""SELECT traj_id, pos, coalesce(CASE WHEN NOT coalesce(s.ok, false) THEN s.tool || chr(10) || coalesce(s.result_head, '') END, NULL) AS failure FROM (SELECT traj_id, unnest(steps) AS s, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T})) WHERE NOT coalesce(s.ok, false)
    UNION ALL SELECT traj_id, 0, coalesce(goal, '') || chr(10) || coalesce(outcome, '') FROM ({_ONCE_T}) WHERE outcome <> 'success'"""
)
def failure_texts(spark, d):
    """What failed steps say, and commands whose exit code isn't zero."""
    t = _trajectories(spark, d)
    s = t.select("traj_id", F.posexplode("steps").alias("k", "s")).select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), M.failure_text(F.col("s.ok"), F.col("s.tool"), F.col("s.result_head")).alias("failure"))
    result = F.to_json(F.struct(F.when(F.col("outcome") == "success", 0).otherwise(2).alias("exit_code"), F.col("goal").alias("stderr"), F.col("outcome").alias("stdout")))
    c = t.select("traj_id", F.lit(0).cast("bigint").alias("pos"), M.failure_text(F.lit(True), F.lit(None).cast("string"), result).alias("failure"))
    return s.union(c).where("failure IS NOT NULL")


@query(f"SELECT traj_id, pos, tool AS name, coalesce(path, '') AS query FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).args->>'$.path' AS path, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))")
def simple_calls(spark, d):
    """Calls with a query that stand in a text, read back."""
    s = _trajectories(spark, d).select("traj_id", F.posexplode("steps").alias("k", "s"))
    text = F.concat(F.lit("Then [tool: "), "s.tool", F.lit('(query = "'), F.coalesce(F.get_json_object("s.args", "$.path"), F.lit("")), F.lit('")] and so on'))
    c = s.select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), F.explode(M.simple_calls(text)).alias("c"))
    return c.select("traj_id", "pos", "c.name", "c.query")


_L = r"string_split_regex(regexp_replace(text, '[\r\n]$', ''), '\r\n|[\n\r]')"
_SHORT = f"CASE WHEN len({_L}) > 6 THEN array_to_string(list_transform(list_filter({_L}[1:3], lambda x: {_TRIM.format('x')} <> ''), lambda x: substr({_TRIM.format('x')}, 1, 120)), ' | ') || ' ... (' || (len({_L}) - 3) || ' more lines)' ELSE substr(text, 1, 600) END"


@query(
    f"""WITH d AS (SELECT doc_id, text, coalesce(lang = 'en', false) AS latest, {_SHORT} AS short FROM documents WHERE text IS NOT NULL AND NOT (starts_with(ltrim(text), '{{') AND contains(text, 'exit_code')))
    SELECT doc_id, CASE WHEN latest AND length(text) <= 4000 THEN text WHEN latest AND length(short) < length(text) THEN short || chr(10) || '(latest, reduced from ' || length(text) || ' chars)' ELSE short END AS reduced FROM d"""
)
def reduced_messages(spark, d):
    """Documents as messages that have grown old; those in English as the latest."""
    docs = _t(spark, d, "documents").where(F.col("text").isNotNull() & ~(F.ltrim("text").startswith("{") & F.col("text").contains("exit_code")))
    return docs.select("doc_id", M.reduce_message(F.col("text"), F.coalesce(F.col("lang") == "en", F.lit(False))).alias("reduced"))


@query(f"SELECT experience_id, CASE WHEN outcome = 'failed' THEN 'failed' WHEN outcome = 'partial' THEN 'partial' WHEN coalesce(verification.attempts[1].ok, false) THEN 'success' WHEN len(verification.attempts) > 0 THEN 'recovered' ELSE 'partial' END AS classified FROM ({_ONCE_E})")
def session_outcomes(spark, d):
    """Outcome of every session by its state and its verification attempts."""
    state = F.when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "partial", "cancelled").otherwise("completed")
    return _experiences(spark, d).select("experience_id", O.session_outcome(state, F.col("verification.attempts")).alias("classified"))


@query(
    f"""WITH s AS (SELECT traj_id, unnest(steps).args->>'$.path' AS uri, generate_subscripts(steps, 1) AS k FROM ({_ONCE_T})), u AS (SELECT traj_id, uri, min(k) AS k FROM s WHERE length(uri) > 0 GROUP BY 1, 2)
    SELECT traj_id, coalesce(final_answer, '') || coalesce(goal, '') AS text, coalesce((SELECT string_agg(uri, ' ' ORDER BY k) FROM u WHERE u.traj_id = t.traj_id), '') AS sources FROM ({_ONCE_T}) t"""
)
def grounded_answers(spark, d):
    """Answers of parts with the addresses they rest on, each once."""
    t = _trajectories(spark, d)
    parts = F.array(F.struct(F.col("final_answer").alias("text")), F.struct(F.col("goal").alias("text")))
    raw = F.to_json(F.struct(parts.alias("parts"), F.transform("steps", lambda s: F.struct(F.get_json_object(s["args"], "$.path").alias("uri"), s["tool"].alias("title"))).alias("sources")))
    text, sources = M.grounded(F.col("raw"))
    return t.select("traj_id", raw.alias("raw")).select("traj_id", text.alias("text"), F.array_join(F.transform(sources, lambda s: s["uri"]), " ").alias("sources"))


@query(
    f"""WITH c AS (SELECT signature, count(*) AS n FROM cases WHERE signature IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT signature, CASE WHEN max(times_passed) > 5 THEN 'reject' ELSE 'accept' END AS decision FROM flakes WHERE signature IS NOT NULL GROUP BY 1)
    SELECT coalesce(decision, 'open') AS lane, count(*) AS candidates, sum(n)::BIGINT AS cases FROM c LEFT JOIN v USING (signature) GROUP BY 1"""
)
def adjudicated(spark, d):
    """Recurring signatures after a table of decisions: taught, rejected, still open."""
    found = _t(spark, d, "cases").where("signature IS NOT NULL").groupBy("signature").agg(F.count("*").alias("n")).where("n >= 2")
    votes = _t(spark, d, "flakes").where("signature IS NOT NULL").groupBy("signature").agg(F.when(F.max("times_passed") > 5, "reject").otherwise("accept").alias("decision"))
    lanes = zip(("accept", "reject", "open"), O.decided(found, votes, "signature"))
    rows = [lane.select(F.lit(name).alias("lane"), "n") for name, lane in lanes]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("lane").agg(F.count("*").alias("candidates"), F.sum("n").alias("cases"))


@query(f"SELECT experience_id, list_contains([contains(lower(coalesce(goal, '')), p) FOR p IN ['restart', 'interrupted', 'again']], true) AS resumes, len(list_filter(string_split_regex(coalesce(goal, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) >= 8 AS substantive FROM ({_ONCE_E})")
def goal_gates(spark, d):
    """Goals that take up interrupted work, and goals of many words."""
    return _experiences(spark, d).select("experience_id", O.is_resume(F.col("goal"), ["restart", "interrupted", "again"]).alias("resumes"), O.substantive(F.col("goal"), 8).alias("substantive"))


@query(f"SELECT traj_id, {_sql_goal(_PLAIN)} AS goal_key FROM ({_ONCE_T})")
def draw_goals(spark, d):
    """Goals by which a fair draw takes turns."""
    return _trajectories(spark, d).select("traj_id", O.goal_key(F.col("goal")).alias("goal_key"))
