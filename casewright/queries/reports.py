"""Queries of decisions, imports, comparisons, checks and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import records as O
from casewright.operators import reports as P
from casewright.plans.session import scratch
from casewright.queries.core import _ONCE_E, _ONCE_T, _RUN, _STRIP, _once, _runs, _t, _ts, query
from casewright.queries.records import _CHAT, _chats
from casewright.sources import sinks


def _tr(spark, d):
    return _once(_t(spark, d, "trajectories"), "traj_id")


def _e(spark, d):
    return _once(_t(spark, d, "experiences"), "experience_id")


_ENV = " OR ".join(f"contains(lower(coalesce(failure, '')), '{m}')" for m in [*P.ENVIRONMENT_MARKERS, "importerror", "timeouterror"])


@query(f"SELECT experience_id, {_ENV} AS environment FROM ({_ONCE_E})")
def environment_failures(spark, d):
    """Failures that speak of the environment."""
    return _e(spark, d).select("experience_id", P.says_any(F.col("failure"), [*P.ENVIRONMENT_MARKERS, "importerror", "timeouterror"]).alias("environment"))


_MARKED = " OR ".join(f"contains(lower(coalesce(failure, '')), '{m}')" for m in P.ENVIRONMENT_MARKERS)


@query(
    f"""WITH i AS (SELECT experience_id, outcome, times_seen AS r, len(tags) AS a, confidence > 0.5 AS e, len(actions) < 7 AS l, len(languages) AS v, len(list_distinct(actions)) >= 4 AS c, ({_MARKED}) AS m FROM ({_ONCE_E}))
    SELECT experience_id, CASE WHEN NOT l THEN 'terminate' WHEN r >= 3 AND a < 2 THEN 'alternate_approach' WHEN r >= 3 AND e THEN 'escalate_model' WHEN r >= 3 THEN 'ask_user' WHEN m AND v < 2 THEN 'environment_check' WHEN c AND a < 2 THEN 'alternate_approach'
    WHEN c AND e THEN 'escalate_model' WHEN c THEN 'ask_user' WHEN outcome = 'failed' THEN 'alternate_approach' ELSE 'retry_with_advice' END AS strategy FROM i"""
)
def recovery_decisions(spark, d):
    """What to do next about every experience, taken as a failure."""
    kind = F.when(F.col("outcome") == "failed", "verification").otherwise("tool")
    strategy, _ = P.recovery(kind, F.col("failure"), F.col("times_seen"), F.size("tags"), F.col("confidence") > 0.5, F.size("actions") < 7, F.size("languages"), F.size(F.array_distinct("actions")) >= 4)
    return _e(spark, d).select("experience_id", strategy.alias("strategy"))


@query(
    f"SELECT traj_id, pos, CASE WHEN tool = 'run_tests' THEN 'allow' WHEN NOT coalesce(ok, true) THEN 'ask' WHEN tool LIKE '%_file' THEN 'ask' WHEN tool LIKE 'git%' THEN 'allow' ELSE 'deny' END AS mode, CASE WHEN tool = 'run_tests' THEN 'rule' WHEN NOT coalesce(ok, true) THEN 'confirmation' WHEN tool LIKE '%_file' OR tool LIKE 'git%' THEN 'level' ELSE 'fallback' END AS tier "
    f"FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).ok AS ok, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))"
)
def permission_tiers(spark, d):
    """Mode of every captured call, by rule, confirmation, level or fallback."""
    s = _tr(spark, d).select("traj_id", F.posexplode("steps").alias("k", "s")).select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), "s.tool", "s.ok")
    rule = F.when(F.col("tool") == "run_tests", F.lit("allow"))
    level = F.when(F.col("tool").endswith("_file"), "write").when(F.col("tool").startswith("git"), "read")
    mode, tier = P.permission(rule, ~F.coalesce("ok", F.lit(True)), level, {"write": "ask", "read": "allow"}, "deny")
    return s.select("traj_id", "pos", mode.alias("mode"), tier.alias("tier"))


@query(
    "WITH l AS (SELECT DISTINCT signature, 1 AS n FROM cases WHERE signature IS NOT NULL), i AS (SELECT signature, 2 AS n FROM flakes WHERE signature IS NOT NULL), t AS (SELECT signature, 'in file' AS reason FROM i GROUP BY 1 HAVING count(*) > 1) "
    "SELECT * FROM t UNION ALL SELECT DISTINCT signature, 'live' FROM i WHERE signature IN (SELECT signature FROM l) AND signature NOT IN (SELECT signature FROM t)"
)
def import_offenders(spark, d):
    """Signatures that stop an import of passes over cases."""
    live = _t(spark, d, "cases").where("signature IS NOT NULL").select("signature").distinct()
    return P.replaced(live, _t(spark, d, "flakes").where("signature IS NOT NULL").select("signature"), "signature")[1]


@query("SELECT signature, max(times_passed) AS n FROM flakes WHERE signature IS NOT NULL AND signature NOT IN (SELECT signature FROM cases WHERE signature IS NOT NULL) GROUP BY 1")
def import_replace(spark, d):
    """The store after an import that nothing stops."""
    live = _t(spark, d, "cases").where("signature IS NOT NULL").select("signature", F.col("times_seen").alias("n"))
    fresh = _t(spark, d, "flakes").where("signature IS NOT NULL").groupBy("signature").agg(F.max("times_passed").alias("n")).join(live.select("signature"), "signature", "left_anti")
    return P.replaced(live, fresh, "signature")[0]


@query(f"WITH r AS ({_RUN}), a AS (SELECT model, run, round(count(*) FILTER (WHERE success) / count(*), 3) AS s, round(avg(iterations), 1) AS i FROM r GROUP BY 1, 2), y AS (SELECT min(run) AS lo, max(run) AS hi FROM r) SELECT x.model, round(z.s - x.s, 3) AS success_rate, round(z.i - x.i, 1) AS avg_iterations FROM a x JOIN a z USING (model), y WHERE x.run = lo AND z.run = hi")
def run_deltas(spark, d):
    """Changes of every model from the first year's run to the last one's."""
    r = _runs(spark, d)
    low, high = r.agg(F.min("run"), F.max("run")).first()
    return P.run_deltas(r.where(F.col("run") == low), r.where(F.col("run") == high), ["model"])


_PACK = [("timeout", "(?i)timeout", None), ("often", "(?i)error", 1), ("seldom", "(?i)unicode|latin", 2)]


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT id, '{i}' AS rule FROM cases WHERE regexp_matches(diagnosis, '{p}')" + (f" AND times_seen = {c}" if c is not None else "") for i, p, c in _PACK) + ") SELECT id, rule, count(*) OVER (PARTITION BY id) > 1 AS ambiguous FROM m")
def rule_matches_with_exit(spark, d):
    """Rules that fit a diagnosis and a number beside it."""
    return P.rule_matches_with_exit(_t(spark, d, "cases"), "id", "diagnosis", "times_seen", _PACK)


@query(
    f"""WITH t AS ({_ONCE_T}), s AS (SELECT traj_id, generate_subscripts(steps, 1) AS k, unnest(steps).tool AS tool, coalesce(unnest(steps).args->>'$.path', '') AS path FROM t),
    f AS (SELECT traj_id, [CASE WHEN NOT coalesce(steps[1].tool IN ('list_directory', 'search_code'), false) THEN 'no look around first' END, CASE WHEN len(list_filter(steps, lambda s: s.tool = 'read_file')) = 0 THEN 'reads nothing' END,
    CASE WHEN EXISTS (SELECT 1 FROM s w WHERE w.traj_id = t.traj_id AND w.tool IN ('write_file', 'edit_file') AND NOT EXISTS (SELECT 1 FROM s r WHERE r.traj_id = w.traj_id AND r.tool = 'read_file' AND r.path = w.path AND r.k < w.k)) THEN 'writes what it has not read' END,
    CASE WHEN length({_STRIP.format("coalesce(final_answer, '')")}) = 0 THEN 'no final answer' END, CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.traj_id = t.traj_id AND path <> '' AND contains(coalesce(final_answer, ''), path)) THEN 'final answer names no file' END,
    CASE WHEN len(list_filter(string_split_regex(coalesce(goal, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) < 3 THEN 'goal under three words' END] AS l FROM t)
    SELECT traj_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), '; ') AS faults FROM f"""
)
def demonstration_faults(spark, d):
    """What keeps every trajectory from being taught as a demonstration."""
    faults = P.demonstration_faults(F.col("goal"), F.col("steps"), F.col("final_answer"), ["list_directory", "search_code"], ["read_file"], ["write_file", "edit_file"])
    return _tr(spark, d).select("traj_id", F.array_join(faults, "; ").alias("faults"))


@query(
    f"SELECT 'total' AS part, 0 AS rank, 'total cases: ' || count(*) AS line FROM cases UNION ALL SELECT 'top', id, 'case #' || id || ' times_seen=' || times_seen || ' sig: ' || signature FROM (SELECT * FROM cases ORDER BY times_seen DESC, id LIMIT 5) "
    f"UNION ALL SELECT 'stale', id, 'case #' || id || ' last_seen=' || last_seen || ' sig: ' || signature FROM cases WHERE {_ts('last_seen')} < TIMESTAMP '2031-06-01' - INTERVAL 30 DAY"
)
def case_report(spark, d):
    """Report on the case base at a fixed time."""
    return P.case_report(_t(spark, d, "cases"), F.timestamp_seconds(F.lit(1938038400)))


_KEY = "user_id || ' ' || event_type"


@query(f"SELECT 'case' AS kind, {_KEY} AS signature, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 2 UNION ALL SELECT 'pass', {_KEY}, count(*) FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 2")
def captured_events(spark, d):
    """Events as failures and passes, each counted in its own store."""
    key = F.concat(F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"))
    failures, passes = P.captured(_t(spark, d, "events"), key, ~F.col("event_type").isin("error", "signup"), F.col("ts"), F.col("value"))
    return failures.select(F.lit("case").alias("kind"), "signature", F.col("times_seen").alias("n")).union(passes.select(F.lit("pass"), "signature", "times_passed"))


@query(
    f"SELECT model, count(*) AS tasks, sum(iterations)::BIGINT AS tool_calls, count(*) FILTER (WHERE NOT success) AS failures, count(*) FILTER (WHERE success AND iterations > 20) AS recoveries FROM ({_RUN}) GROUP BY 1"
)
def eval_sums(spark, d):
    """Sums of calls, failures and recoveries of every model."""
    return _runs(spark, d).groupBy("model").agg(F.count("*").alias("tasks"), F.sum("iterations").alias("tool_calls"), F.count_if(~F.col("success")).alias("failures"), F.count_if(F.col("success") & (F.col("iterations") > 20)).alias("recoveries"))


@query(f"SELECT traj_id, failed FROM (SELECT traj_id, session_id, len(list_filter(steps, lambda s: s.ok = false)) AS failed FROM ({_ONCE_T})) ORDER BY failed, session_id NULLS FIRST, traj_id LIMIT 50")
def cleanest_first(spark, d):
    """The fifty trajectories with fewest failed steps."""
    rows = _tr(spark, d).select("traj_id", "session_id", O.failed_steps(F.col("steps")).cast("bigint").alias("failed"))
    return rows.orderBy("failed", F.asc_nulls_first("session_id"), "traj_id").limit(50).select("traj_id", "failed")


@query(
    f"{_CHAT}, n AS (SELECT traj_id, count(*) AS messages FROM m GROUP BY 1) SELECT t.traj_id, messages, t.verdict, len(t.steps) AS steps FROM n JOIN ({_ONCE_T}) t USING (traj_id) WHERE verdict = 'ACCEPT' AND trajectory_class IN ('successful', 'recovered')"
)
def exported_training(spark, d):
    """Chats of accepted trajectories, written as a training file and read back."""
    kept = _tr(spark, d).where("verdict = 'ACCEPT' AND trajectory_class IN ('successful', 'recovered')").select("traj_id", "verdict", F.size("steps").alias("steps"))
    rows = _chats(spark, d).join(kept, "traj_id").select("traj_id", "messages", F.struct("verdict", "steps").alias("metadata"))
    path = f"{scratch(spark)}/training.jsonl"
    sinks.write_lines(rows, path, ["traj_id"])
    got = spark.read.schema("traj_id BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>, metadata STRUCT<verdict: STRING, steps: BIGINT>").json(path)
    return got.select("traj_id", F.size("messages").cast("bigint").alias("messages"), "metadata.verdict", "metadata.steps")


@query(
    f"SELECT count(*) AS trajectories, count(*) FILTER (WHERE verdict = 'ACCEPT') AS accepted, count(*) FILTER (WHERE len(steps) > 0) AS step_trainable, count(*) FILTER (WHERE list_contains(tags, 'demo')) AS deliberate, sum(len(list_filter(steps, lambda s: s.ok = false)))::BIGINT AS failed_turns, count(*) FILTER (WHERE truncated) AS truncated FROM ({_ONCE_T})"
)
def training_report(spark, d):
    """Counts of a training set's build."""
    c = lambda x: F.count_if(x)
    return _tr(spark, d).agg(
        F.count("*").alias("trajectories"), c(F.col("verdict") == "ACCEPT").alias("accepted"), c(O.trainable(F.col("steps"))).alias("step_trainable"), c(O.tagged_any(F.col("tags"), ["demo"])).alias("deliberate"), F.sum(O.failed_steps(F.col("steps"))).alias("failed_turns"), c("truncated").alias("truncated")
    )


_LINE = r"regexp_extract(goal, '^([^\r\n]*)', 1)"


@query(f"SELECT recorded_at AS ts, {_LINE} AS text FROM ({_ONCE_E}) WHERE contains(lower({_LINE}), 'cache')")
def journal_grep(spark, d):
    """Journal entries about caches."""
    from casewright.sources.text import journal_entries

    lines = _e(spark, d).select(F.concat(F.lit("## "), "recorded_at", F.lit(" "), F.regexp_extract("goal", r"^([^\r\n]*)", 1)).alias("line"))
    return journal_entries(lines).where(F.contains(F.lower("text"), F.lit("cache")))


def _hidden(c: str) -> str:
    for _, p in X.CREDENTIALS:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@query(f"SELECT traj_id, pos, {_hidden('head')} AS head, {_hidden('goal')} AS goal FROM (SELECT traj_id, goal, unnest(steps).result_head AS head, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))")
def redacted_steps(spark, d):
    """Steps and goals with credentials replaced at any depth of the record."""
    safe = sinks.redacted(_tr(spark, d).select("traj_id", "goal", "steps"))
    return safe.select("traj_id", F.posexplode("steps").alias("k", "s"), "goal").select("traj_id", (F.col("k") + 1).cast("bigint").alias("pos"), F.col("s.result_head").alias("head"), "goal")
