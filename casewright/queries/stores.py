"""Queries of databases, listings, feeds and reviews, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import relational as R
from casewright.operators import sequences as S
from casewright.plans import knowledge as K
from casewright.plans.session import scratch
from casewright.queries.core import _ONCE_E, _ONCE_T, _once, _t, query
from casewright.sources import databases, trees
from casewright.streaming import feeds
from casewright.streaming import stores as ST


def _tr(spark, d):
    return _once(_t(spark, d, "trajectories"), "traj_id")


@query(f"SELECT t.traj_id, t.session_id AS lab_session_id, s.source AS agent, s.status FROM ({_ONCE_T}) t JOIN (SELECT session_id, min(source) AS source, min(verdict) AS status FROM ({_ONCE_T}) WHERE session_id IS NOT NULL GROUP BY 1) s USING (session_id) WHERE s.source = 'teacher'")
def agent_transcripts(spark, d):
    """Transcripts of the sessions of one agent."""
    t = _tr(spark, d).where("session_id IS NOT NULL")
    s = t.groupBy(F.col("session_id").alias("id")).agg(F.min("source").alias("agent"), F.min("verdict").alias("status"), F.lit("/work").alias("directory"))
    return databases.transcripts_of(t.select("traj_id", F.col("session_id").alias("lab_session_id")), s, "teacher").select("traj_id", "lab_session_id", "agent", "status")


@query("WITH e AS (SELECT DISTINCT split_part(source, '/', 1) AS name, contains(source, '/') AS is_folder FROM documents WHERE source IS NOT NULL) SELECT name, is_folder, row_number() OVER (ORDER BY is_folder DESC, lower(name), name) AS rank FROM e WHERE name <> '' ORDER BY rank LIMIT 500")
def folder_entries(spark, d):
    """What lies in the root of all sources, folders first."""
    return trees.entries(_t(spark, d, "documents").where("source IS NOT NULL"), "source").withColumn("rank", F.col("rank").cast("bigint"))


_PATHS = f"SELECT DISTINCT args->>'$.path' AS path FROM (SELECT unnest(steps).args AS args FROM ({_ONCE_T})) WHERE (args->>'$.path') IS NOT NULL"


def _paths(spark, d):
    s = _tr(spark, d).select(F.explode("steps").alias("s")).select(F.get_json_object("s.args", "$.path").alias("path"))
    return s.where("path IS NOT NULL").distinct()


@query(rf"SELECT path, CASE lower(regexp_extract(path, '\.([^./\\]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'tsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' ELSE 'text' END AS language FROM ({_PATHS})")
def path_languages(spark, d):
    """Language of every path that steps name."""
    return _paths(spark, d).select("path", trees.language(F.col("path")).alias("language"))


@query(rf"SELECT path FROM ({_PATHS}) WHERE lower(regexp_extract(path, '\.([^./\\]+)$', 1)) IN ('json', 'toml', 'yaml', 'yml', 'ini', 'cfg') UNION SELECT replace(path, '.py', '.toml') FROM ({_PATHS}) WHERE contains(path, '.py') AND NOT contains('/' || path, '/.git/')")
def config_paths(spark, d):
    """Configuration files among paths and those beside Python files."""
    p = _paths(spark, d)
    more = p.where(F.col("path").contains(".py")).select(F.replace("path", F.lit(".py"), F.lit(".toml")).alias("path"))
    return trees.config_files(p.union(more), "path").distinct()


@query(f"WITH r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS repo FROM ({_PATHS}) WHERE contains(path, '/')), t AS (SELECT repo FROM r UNION SELECT DISTINCT split_part(repo, '/', 1) FROM r WHERE starts_with(repo, 't')) SELECT repo FROM t WHERE len(string_split(repo, '/')) <= 3 AND NOT EXISTS (SELECT 1 FROM t o WHERE starts_with(t.repo, o.repo || '/'))")
def repository_roots(spark, d):
    """Repositories in a tree where every folder of paths is one, and so are some of the folders above."""
    r = _paths(spark, d).where(F.col("path").contains("/")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("r"))
    tops = r.where(F.col("r").startswith("t")).select(F.split("r", "/")[0].alias("r"))
    return trees.repositories(r.union(tops).select(F.concat("r", F.lit("/.git/HEAD")).alias("path")), "path")


@query("SELECT n_nationkey, CASE WHEN n > 0 THEN 'dirty' WHEN n_regionkey = 0 THEN 'no remote' WHEN n_nationkey % 3 > 0 AND n_nationkey % 2 > 0 THEN 'diverged' WHEN n_nationkey % 3 > 0 THEN 'ahead' WHEN n_nationkey % 2 > 0 THEN 'behind' ELSE 'clean' END AS state FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def repository_states(spark, d):
    """State of nations as repositories: suppliers in debt are changes."""
    n = _t(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") != 0).alias("remote"), (F.col("n_nationkey") % 3).alias("ahead"), (F.col("n_nationkey") % 2).alias("behind"))
    return trees.repository_state(n, _t(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query(
    f"""WITH u AS (SELECT 'case' AS source, id::VARCHAR AS key, times_seen::DOUBLE AS score FROM cases WHERE contains(lower(concat_ws(' ', signature, diagnosis)), 'stale') OR contains(lower(concat_ws(' ', signature, diagnosis)), 'manifest')
    UNION ALL SELECT 'document', doc_id::VARCHAR, (contains(lower(concat_ws(' ', text, heading)), 'stale')::INT + contains(lower(concat_ws(' ', text, heading)), 'manifest')::INT) / 2 FROM documents
    UNION ALL SELECT 'experience', experience_id, CASE WHEN o > 0 THEN 2 * o + 0.5 * least(times_seen, 5) + coalesce(confidence, 0) ELSE 0 END FROM (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(goal), '[\\p{{L}}\\p{{N}}]+')), ['stale', 'manifest'])) AS o FROM ({_ONCE_E}))),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS rank FROM u WHERE score > 0) SELECT source, key, round(score, 6) AS score, rank FROM r WHERE rank <= 3"""
)
def unified_search(spark, d):
    """The three best of each store for a question."""
    found = K.unified_search(_t(spark, d, "cases"), _t(spark, d, "documents"), _once(_t(spark, d, "experiences"), "experience_id"), "stale manifest")
    return found.select("source", "key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "WITH v AS (SELECT signature, max(times_passed) AS n FROM flakes WHERE signature IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN hit AND n > 5 THEN 'passes ' || n ELSE diagnosis END AS diagnosis, CASE WHEN hit THEN 'reviewer' ELSE confirmed_by END AS confirmed_by "
    "FROM (SELECT c.id, c.diagnosis, c.confirmed_by, v.n, v.n IS NOT NULL AND coalesce(c.confirmed_by = 'unknown', true) AS hit FROM cases c LEFT JOIN v USING (signature))"
)
def reviewed_cases(spark, d):
    """Cases after a review by what has passed: often passed ones are corrected, others confirmed."""
    c = _t(spark, d, "cases")
    v = _t(spark, d, "flakes").where("signature IS NOT NULL").groupBy("signature").agg(F.max("times_passed").alias("n"))
    decisions = c.select("id", "signature").join(v, "signature").select("id", F.when(F.col("n") > 5, "correct").otherwise("confirm").alias("action"), F.lit("reviewer").alias("by"), F.concat(F.lit("passes "), "n").alias("diagnosis"))
    return K.reviewed(c.select("id", "signature", "diagnosis", "confirmed_by"), decisions).select("id", "diagnosis", "confirmed_by")


@query("WITH v AS (SELECT signature, max(times_passed) AS n FROM flakes WHERE signature IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN n IS NOT NULL OR confirmed_by IS NOT NULL THEN 'done' ELSE 'todo' END AS status, CASE WHEN confirmed_by IS NOT NULL THEN confirmed_by WHEN n IS NOT NULL THEN 'now' END AS done_at FROM cases LEFT JOIN v USING (signature) WHERE n IS NULL OR n <= 5")
def changed_tasks(spark, d):
    """Cases as tasks after changes: passed ones are done, often passed ones leave."""
    c = _t(spark, d, "cases")
    tasks = c.select("id", F.when(F.col("confirmed_by").isNull(), "todo").otherwise("done").alias("status"), F.col("confirmed_by").alias("done_at"))
    v = _t(spark, d, "flakes").where("signature IS NOT NULL").groupBy("signature").agg(F.max("times_passed").alias("n"))
    changes = c.select("id", "signature").join(v, "signature").select("id", F.when(F.col("n") > 5, "delete").otherwise("done").alias("op"), F.lit("now").alias("at"))
    return K.changed_tasks(tasks, changes)


@query(f"SELECT source AS category, count(*) AS runs, count(*) FILTER (WHERE outcome = 'success') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'recovered') AS recovered FROM ({_ONCE_T}) GROUP BY 1")
def corpus_stats(spark, d):
    """Runs of every category by outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return _tr(spark, d).groupBy(F.col("source").alias("category")).agg(F.count("*").alias("runs"), count("success").alias("passed"), count("failed").alias("failed"), count("recovered").alias("recovered"))


@query(f"SELECT traj_id, substr(curated_at::VARCHAR, 1, 19) AS at FROM ({_ONCE_T}) ORDER BY curated_at DESC, traj_id LIMIT 20")
def newest_trajectories(spark, d):
    """The twenty newest trajectories."""
    return R.top(_tr(spark, d), [F.desc("curated_at"), F.asc("traj_id")], 20).select("traj_id", F.substring(F.col("curated_at").cast("string"), 1, 19).alias("at"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS value FROM events)) WHERE t <= 100 OR k = 1")
def budgeted_events(spark, d):
    """Newest events of every user whose values fit a budget."""
    e = _t(spark, d, "events").withColumn("v", F.floor("value"))
    return S.budgeted_latest(e, "user_id", [F.desc("ts"), F.desc("event_id")], "v", 100).select("event_id", "user_id")


def _folder(spark, d):
    """Events numbered by user as a folder of files in the shared folder."""
    base = scratch(spark)
    e = ST.numbered_events(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    e.select("user_id", F.col("seq").cast("bigint").alias("seq"), "event_id", (F.col("event_type") != "error").alias("ok")).write.parquet(f"{base}/events")
    return base, "user_id bigint, seq bigint, event_id bigint, ok boolean"


def _run(stream, base, name, ddl, spark):
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ddl).parquet(f"{base}/{name}")


@query("SELECT event_id, user_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 10")
def replayed_events(spark, d):
    """What a subscriber who has seen ten events of each user gets: the past from there on, by a stream."""
    base, ddl = _folder(spark, d)
    out = feeds.subscription(spark, f"{base}/events", ddl, after=10)
    return _run(out, base, "out", ddl, spark).select("event_id", "user_id", "seq")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), f AS (SELECT DISTINCT user_id AS key, 0::BIGINT AS seq, 1 AS level, 0 AS good, 0 AS bad FROM events UNION ALL
    SELECT f.key, f.seq + 1, CASE WHEN ok AND good + 1 >= 3 THEN least(level + 1, 8) WHEN NOT ok AND bad + 1 >= 2 THEN greatest(level - 1, 1) ELSE level END, CASE WHEN ok AND good + 1 < 3 THEN good + 1 ELSE 0 END, CASE WHEN NOT ok AND bad + 1 < 2 THEN bad + 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.key AND e.seq = f.seq + 1)
    SELECT key, seq, level FROM f WHERE seq > 0"""
)
def stream_mastery(spark, d):
    """Level of every user after each event, kept as state of a stream."""
    base, ddl = _folder(spark, d)
    levels = feeds.mastery(spark.readStream.schema(ddl).parquet(f"{base}/events"), "user_id", "seq", "ok")
    return _run(levels, base, "levels", "key bigint, seq bigint, level int", spark)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE ends_with(lower(source), '.md')) AS digested, count(DISTINCT sha256(coalesce(text, ''))) AS hashes FROM (SELECT source, max(text) AS text FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE text IS NOT NULL")
def digested_changes(spark, d):
    """Files that a watch cycle records and digests when all that hold text are new."""
    files = _t(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.max("text").alias("text"))
    changes = files.select("source", F.when(F.col("text").isNull(), "removed").otherwise("new").alias("change"))
    sections, ledger = feeds.digest_changes(changes, files, "source", "text")
    counts = sections.agg(F.count_distinct("source").alias("digested"))
    return ledger.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("hashes")).crossJoin(F.broadcast(counts)).select("files", "digested", "hashes")  # one row each
