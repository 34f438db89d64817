"""Queries of the reference operators, each with DuckDB SQL over the same whole tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.calls import calls_of, render_call
from casewright.operators import aggregates as A
from casewright.operators import checks as C
from casewright.operators import relational as R
from casewright.operators import sequences as S
from casewright.plans import pipelines as P
from casewright.plans.session import scratch
from casewright.sources import text as T
from casewright.sources.pages import OTHER_FORM, SCRIPT_FORMS, SCRIPT_IMPORT, definitions, extract_code, extract_pages, importers, references
from casewright.sources.sinks import canonical_lines
from casewright.streaming import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that it is compared with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts(c: str) -> str:
    """SQL of the UTC timestamp of a stamp string."""
    sign = f"CASE WHEN regexp_matches({c}, '[+-]\\d\\d:\\d\\d$') THEN (CASE WHEN substr({c}, -6, 1) = '-' THEN -1 ELSE 1 END) * (substr({c}, -5, 2)::INT * 60 + substr({c}, -2, 2)::INT) ELSE 0 END"
    return f"(try_strptime(substr({c}, 1, 19), '%Y-%m-%dT%H:%M:%S') - to_minutes({sign}))"


_COLLAPSE = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
_BASE = r"""regexp_replace({}, '[^\s''"]*[\\/]([^\s''"\\/]*)', '\1', 'g')"""


def _sql_norm(c: str) -> str:
    return f"replace(lower({_BASE.format(_COLLAPSE.format(c))}), 'ß', 'ss')"


def _sql_goal(c: str) -> str:
    return _COLLAPSE.format(rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')")


def _sql_canonical(c: str) -> str:
    """SQL of the canonical signature of a composed one."""
    return f"(SELECT {_sql_norm('h')} || ' :: ' || {_sql_norm('t')} FROM (SELECT CASE WHEN instr(x, ' :: ') > 0 THEN substr(x, 1, instr(x, ' :: ') - 1) ELSE x END AS h, CASE WHEN instr(x, ' :: ') > 0 THEN substr(x, instr(x, ' :: ') + 4) ELSE '' END AS t FROM (SELECT {c} AS x)))"


_FOLD_CASES = f"SELECT signature, min(id) AS id, sum(times_seen)::BIGINT AS times_seen, max({_ts('last_seen')}) AS last_seen, count(*) AS records FROM cases WHERE signature IS NOT NULL GROUP BY signature"
_FOLD_FLAKES = f"SELECT signature, sum(times_passed)::BIGINT AS times_passed, max({_ts('last_pass')}) AS last_pass FROM (SELECT DISTINCT * FROM flakes) WHERE signature IS NOT NULL GROUP BY signature"
_ONCE_E = "SELECT DISTINCT * FROM experiences"
_ONCE_T = "SELECT DISTINCT * FROM trajectories"


def _once(df: DataFrame, key: str) -> DataFrame:
    """A redelivered row counts once: equal copies of a record by its key."""
    return df.dropDuplicates([key])


# ---- cases and flakes ------------------------------------------------------------------------------------------------


@query(f"SELECT signature, id, times_seen, epoch(last_seen)::BIGINT AS last_seen, records FROM ({_FOLD_CASES})")
def case_upsert(spark, d):
    """Case store by signature."""
    return R.fold_cases(_t(spark, d, "cases")).select("signature", "id", "times_seen", X.epoch(F.col("last_seen")).alias("last_seen"), "records")


@query("SELECT id, signature, times_seen FROM cases ORDER BY times_seen DESC, id LIMIT 5")
def top_cases(spark, d):
    """The five cases seen most."""
    return R.top(_t(spark, d, "cases").select("id", "signature", "times_seen"), [F.desc("times_seen"), F.asc("id")], 5)


@query(f"SELECT id FROM cases WHERE {_ts('last_seen')} < (SELECT max({_ts('last_seen')}) FROM cases) - INTERVAL 30 DAY")
def stale_cases(spark, d):
    """Cases not seen in the 30 days before the latest sighting."""
    cases = _t(spark, d, "cases").select("id", "last_seen")
    now = cases.agg(F.max(X.parse_stamp(F.col("last_seen"))).alias("_now"))
    return R.stale(cases.crossJoin(F.broadcast(now)), F.col("_now")).select("id")  # one row of now


@query("SELECT confirmed_by, count(*) AS n, sum(times_seen)::BIGINT AS seen FROM cases WHERE confirmed_by = 'unknown' GROUP BY 1")
def pending_cases(spark, d):
    """Cases nobody confirmed."""
    return R.pending(_t(spark, d, "cases")).groupBy("confirmed_by").agg(F.count("*").alias("n"), F.sum("times_seen").alias("seen"))


@query("SELECT c.id, c.signature, c.times_seen, n > 1 AS ambiguous FROM cases c JOIN (SELECT signature, count(*) AS n FROM cases GROUP BY 1) USING (signature) WHERE signature IN (SELECT signature FROM flakes)")
def lookup_cases(spark, d):
    """Cases of the signatures that have passed, and whether a signature is ambiguous."""
    return R.lookup(_t(spark, d, "cases"), _t(spark, d, "flakes").select("signature")).select("id", "signature", "times_seen", "ambiguous")


@query(
    f"SELECT id, {_sql_norm('head')} || ' :: ' || {_sql_norm('tail')} AS canonical FROM (SELECT id, CASE WHEN instr(signature, ' :: ') > 0 THEN substr(signature, 1, instr(signature, ' :: ') - 1) ELSE signature END AS head, "
    "CASE WHEN instr(signature, ' :: ') > 0 THEN substr(signature, instr(signature, ' :: ') + 4) ELSE '' END AS tail FROM cases)"
)
def signature_norm(spark, d):
    """Canonical signature of every case."""
    return _t(spark, d, "cases").select("id", X.canonical_signature(F.col("signature")).alias("canonical"))


@query(f"SELECT signature, id, round(times_passed / (times_passed + times_seen), 6) AS pass_rate, times_passed / (times_passed + times_seen) > 0.5 AS chronic FROM ({_FOLD_CASES}) JOIN ({_FOLD_FLAKES}) USING (signature)")
def flaky_rates(spark, d):
    """Pass rate and chronic flag of every signature that failed and passed."""
    return R.flaky_rates(_t(spark, d, "cases"), _t(spark, d, "flakes")).select("signature", "id", F.round("pass_rate", 6).alias("pass_rate"), "chronic")


@query(
    f"SELECT signature, id, times_seen, times_passed, round(times_passed / (times_passed + times_seen), 6) AS pass_rate FROM ({_FOLD_CASES}) JOIN ({_FOLD_FLAKES}) USING (signature) "
    "WHERE times_passed / (times_passed + times_seen) > 0.5 ORDER BY pass_rate DESC, id"
)
def flaky_report(spark, d):
    """Chronic flakes, most certain first."""
    rows = R.flaky_rates(_t(spark, d, "cases"), _t(spark, d, "flakes")).where("chronic")
    return rows.select("signature", "id", "times_seen", "times_passed", F.round("pass_rate", 6).alias("pass_rate")).orderBy(F.desc("pass_rate"), "id")


@query(
    f"SELECT signature, id, kind FROM (SELECT signature, id, CASE WHEN times_passed IS NULL AND times_seen = 1 THEN 'first-time' WHEN times_passed / (times_passed + times_seen) <= 0.5 AND times_passed >= 3 "
    f"AND last_seen > last_pass THEN 'regression' END AS kind FROM ({_FOLD_CASES}) LEFT JOIN ({_FOLD_FLAKES}) USING (signature)) WHERE kind IS NOT NULL"
)
def regressions(spark, d):
    """First-time failures and regressions."""
    return R.regressions(_t(spark, d, "cases"), _t(spark, d, "flakes"))


@query(
    f"WITH h AS (SELECT diagnosis AS dg, {_sql_norm('split_part(signature, chr(32) || chr(58) || chr(58) || chr(32), 1)')} || ' :: ' || {_sql_norm('CASE WHEN instr(signature, chr(32) || chr(58) || chr(58) || chr(32)) > 0 THEN substr(signature, instr(signature, chr(32) || chr(58) || chr(58) || chr(32)) + 4) ELSE chr(32) END')} AS s FROM holdout), "
    "c AS (SELECT signature AS s, count(*) AS n, min(diagnosis) AS found FROM cases GROUP BY 1) SELECT count(*) FILTER (WHERE coalesce(n, 0) = 1 AND found IS NOT DISTINCT FROM dg) AS hits, count(*) AS total, "
    "round(100 * hits / total)::BIGINT AS pct FROM h LEFT JOIN c USING (s)"
)
def holdout_recall(spark, d):
    """How many holdout entries the case base recalls."""
    return R.recall(_t(spark, d, "holdout"), _t(spark, d, "cases"))


@query("SELECT id, 'Diagnose this failure: ' || signature AS instruction, error_excerpt AS input, diagnosis AS output FROM cases WHERE signature NOT IN (SELECT signature FROM holdout WHERE signature IS NOT NULL) AND length(diagnosis) > 0")
def instruction_pairs(spark, d):
    """Cases as instruction pairs without those of the holdout."""
    kept = R.exclude(_t(spark, d, "cases"), "signature", _t(spark, d, "holdout"), "signature").where(X.present(F.col("diagnosis")))
    return kept.select("id", F.concat(F.lit("Diagnose this failure: "), "signature").alias("instruction"), F.col("error_excerpt").alias("input"), F.col("diagnosis").alias("output"))


@query("SELECT id, times_seen, round(least(times_seen / 20, 1.0), 3) AS confidence FROM cases WHERE times_seen >= 3")
def detect_recurring(spark, d):
    """Cases that recur, with confidence."""
    return A.recurring(_t(spark, d, "cases")).select("id", "times_seen", "confidence")


_CLUSTER = r"regexp_replace(lower(substr(error_excerpt, 1, 80)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query(f"SELECT {_CLUSTER} AS cluster, count(*) AS size, min(id) AS first_id, max(id) AS last_id, round(least(count(*) / 5, 1.0), 3) AS confidence FROM cases GROUP BY 1 HAVING count(*) >= 2 AND cluster <> ''")
def detect_clusters(spark, d):
    """Cases whose excerpts begin alike."""
    return A.clusters(_t(spark, d, "cases"), "error_excerpt")


@query(
    f"WITH c AS (SELECT signature, times_seen, {_ts('last_seen')} < TIMESTAMP '2031-07-01' AS early FROM cases), a AS (SELECT signature, sum(times_seen)::BIGINT AS n FROM c WHERE early GROUP BY 1), "
    "b AS (SELECT signature, sum(times_seen)::BIGINT AS n FROM c WHERE NOT early GROUP BY 1) SELECT signature, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS times_seen, a.n IS NULL AS added FROM a FULL JOIN b USING (signature)"
)
def import_merge_add(spark, d):
    """The later half of the year merged into the earlier one."""
    c = _t(spark, d, "cases").select("signature", "times_seen", (X.epoch(X.parse_stamp(F.col("last_seen"))) < 1940630400).alias("early"))
    half = lambda e: c.where(F.col("early") == e).groupBy("signature").agg(F.sum("times_seen").alias("times_seen"))
    return A.merge_import(half(True), half(False))


@query(
    f"WITH p AS (SELECT id AS target, merged_from AS source FROM cases WHERE merged_from IN (SELECT id FROM cases)), s AS (SELECT p.target AS id, sum(c.times_seen)::BIGINT AS n, arg_max(c.last_seen, ({_ts('c.last_seen')}, c.last_seen)) AS l FROM p JOIN cases c ON c.id = p.source GROUP BY 1) "
    f"SELECT id, times_seen + coalesce(n, 0) AS times_seen, CASE WHEN {_ts('l')} > {_ts('last_seen')} THEN l ELSE last_seen END AS last_seen FROM cases LEFT JOIN s USING (id) WHERE id NOT IN (SELECT source FROM p)"
)
def merge_pair(spark, d):
    """Cases after the merges that ``merged_from`` names."""
    cases = _t(spark, d, "cases")
    pairs = cases.where("merged_from IS NOT NULL").select(F.col("id").alias("target"), F.col("merged_from").alias("source"))
    pairs = pairs.join(cases.select(F.col("id").alias("source")), "source", "left_semi")
    return A.merge_pairs(cases, pairs).select("id", "times_seen", "last_seen")


def _sql_case(c: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for p, n in rules) + f" ELSE '{default}' END"


_SUBJECT = _sql_case("lower(coalesce(signature, '') || ' ' || coalesce(error_excerpt, ''))", X.SUBJECTS, "unknown")
_ALL = "(VALUES " + ", ".join(f"('{c}')" for c in X.CATEGORIES) + ") v(category)"


@query(f"SELECT category, coalesce(n, 0) AS cases, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < 3 THEN 'thin' ELSE 'covered' END AS status FROM {_ALL} LEFT JOIN (SELECT {_SUBJECT} AS category, count(*) AS n FROM cases GROUP BY 1) USING (category)")
def category_gaps(spark, d):
    """Cases of every category, gaps included."""
    return A.category_gaps(_t(spark, d, "cases"))


_ENV = _sql_case("lower(coalesce({}, ''))", [(p, n) for n, p in X.ENVIRONMENTS], "unsure")


@query(f"SELECT {_ENV.format(*['error_excerpt'] * len(X.ENVIRONMENTS))} AS environment, {_SUBJECT} AS subject, count(*) AS n FROM cases GROUP BY 1, 2")
def env_classify(spark, d):
    """Environment class and subject of all cases."""
    c = _t(spark, d, "cases").select("error_excerpt", X.subject_text(F.col("signature"), F.col("error_excerpt")).alias("_t"))
    c = c.select(X.environment_of(F.col("error_excerpt")).alias("environment"), X.subject_of(F.col("_t")).alias("subject"))
    return c.groupBy("environment", "subject").agg(F.count("*").alias("n"))


# ---- text ------------------------------------------------------------------------------------------------------------


def _sql_redact(c: str) -> str:
    for _, p in X.CREDENTIALS:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@query(f"SELECT experience_id, {_sql_redact('failure')} AS failure, {_sql_redact('resolution')} AS resolution FROM ({_ONCE_E})")
def redaction(spark, d):
    """Failure and resolution of experiences with credential-shaped matches replaced."""
    e = _once(_t(spark, d, "experiences"), "experience_id")
    return e.select("experience_id", X.redact(F.col("failure")).alias("failure"), X.redact(F.col("resolution")).alias("resolution"))


_SCAN = "concat_ws(chr(10), nullif(goal, ''), nullif(array_to_string(actions, ' '), ''), nullif(failure, ''), nullif(diagnosis, ''), nullif(resolution, ''), nullif(context, ''))"


@query(
    "SELECT flag, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS flag FROM ({_ONCE_E}) WHERE regexp_matches({_SCAN}, '{p}')" for n, p in [*X.CREDENTIALS, *X.DESTRUCTIVE])
    + ") GROUP BY 1"
)
def hard_flags(spark, d):
    """Records of every credential or command pattern."""
    e = _once(_t(spark, d, "experiences"), "experience_id").select(X.flags(P.scan_text()).alias("f"))
    return A.exploded_tally(e, "f", "flag")


@query(
    f"SELECT traj_id, len(m) AS markers, array_to_string(m, '|') AS which FROM (SELECT traj_id, list_sort(list_distinct(regexp_extract_all(lower(final_answer), '({X.UNSURE.replace(chr(39), chr(39) * 2)})', 1))) AS m FROM ({_ONCE_T})) WHERE len(m) > 0"
)
def low_confidence(spark, d):
    """Answers with markers of low confidence."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").select("traj_id", X.unsure_markers(F.col("final_answer")).alias("m")).where(F.size("m") > 0)
    return t.select("traj_id", F.size("m").cast("bigint").alias("markers"), F.array_join("m", "|").alias("which"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"SELECT sha256({_STRIP.format('text')}) AS content_hash, min(doc_id) AS first_key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def digest_dedup(spark, d):
    """Distinct texts by content hash."""
    return A.dedupe_by_hash(_t(spark, d, "documents"), "text", "doc_id")


_WORDS = ["ticket", "planner", "windows"]


@query("SELECT doc_id, round((" + " + ".join(f"contains(lower(concat_ws(' ', text, heading)), '{w}')::INT" for w in _WORDS) + ") / 3, 6) AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def digest_search(spark, d):
    """The ten densest documents for three keywords."""
    hit = R.keyword_density(_t(spark, d, "documents"), ["text", "heading"], _WORDS).select("doc_id", F.round("score", 6).alias("score"))
    return R.top(hit, [F.desc("score"), F.asc("doc_id")], 10)


@query("SELECT id FROM cases WHERE contains(lower(concat_ws(' ', signature, diagnosis)), 'timeout') OR contains(lower(concat_ws(' ', signature, diagnosis)), 'stale')")
def keyword_any(spark, d):
    """Cases that hold any of two keywords."""
    return R.keyword_any(_t(spark, d, "cases"), ["signature", "diagnosis"], ["timeout", "stale"]).select("id")


_AT = "instr(lower(diagnosis), 'stale')"
_FROM = f"greatest({_AT} - 80, 1)"


@query(
    f"SELECT id, CASE WHEN {_FROM} > 1 THEN '…' ELSE '' END || {_COLLAPSE.format(f'substr(diagnosis, {_FROM}, 160)')} || CASE WHEN {_FROM} + 160 <= length(diagnosis) THEN '…' ELSE '' END AS snippet FROM cases WHERE contains(lower(diagnosis), 'stale')"
)
def snippets(spark, d):
    """Text around a keyword."""
    c = _t(spark, d, "cases").where(F.lower("diagnosis").contains("stale"))
    return c.select("id", X.snippet(F.col("diagnosis"), ["stale"]).alias("snippet"))


@query(
    f"WITH e AS ({_ONCE_E}), s AS (SELECT experience_id, len(list_intersect(list_distinct(regexp_extract_all(lower(goal), '[\\p{{L}}\\p{{N}}]+')), ['fix', 'flaky', 'test', 'windows'])) AS overlap, times_seen, confidence FROM e) "
    "SELECT experience_id, overlap, round(2 * overlap + 0.5 * least(times_seen, 5) + coalesce(confidence, 0), 6) AS score FROM s WHERE overlap > 0 ORDER BY score DESC, experience_id LIMIT 20"
)
def similar_experiences(spark, d):
    """The 20 experiences nearest to a query."""
    e = _once(_t(spark, d, "experiences"), "experience_id")
    hit = R.similar(e, "goal", "fix flaky test windows", "times_seen", "confidence").select("experience_id", F.col("overlap").cast("bigint").alias("overlap"), F.round("score", 6).alias("score"))
    return R.top(hit, [F.desc("score"), F.asc("experience_id")], 20)


@query(
    "WITH u AS (SELECT 'case' AS source, id::VARCHAR AS key, 2.0 AS score, times_seen AS o FROM cases WHERE contains(lower(signature || ' ' || coalesce(diagnosis, '')), 'timeout') "
    "UNION ALL SELECT 'document', doc_id::VARCHAR, 1.5, n_chars FROM documents WHERE contains(lower(text), 'timeout') "
    f"UNION ALL SELECT 'experience', experience_id, 3.0, times_seen FROM ({_ONCE_E}) WHERE contains(lower(goal), 'timeout')), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o DESC NULLS LAST, key) AS rank FROM u) "
    "SELECT source, key, score, rank FROM r WHERE rank <= 3"
)
def memory_union(spark, d):
    """Best three hits of each memory for one word."""
    has = lambda c: F.lower(c).contains("timeout")
    row = lambda df, s, k, v, o: df.select(F.lit(s).alias("source"), F.col(k).cast("string").alias("key"), F.lit(v).alias("score"), F.col(o).alias("o"))
    cases = row(_t(spark, d, "cases").where(has(F.concat("signature", F.lit(" "), F.coalesce("diagnosis", F.lit(""))))), "case", "id", 2.0, "times_seen")
    docs = row(_t(spark, d, "documents").where(has(F.col("text"))), "document", "doc_id", 1.5, "n_chars")
    seen = row(_once(_t(spark, d, "experiences"), "experience_id").where(has(F.col("goal"))), "experience", "experience_id", 3.0, "times_seen")
    return R.top_per(cases.union(docs).union(seen), ["source"], [F.desc_nulls_last("o"), F.asc("key")], 3).drop("o")


_RULES = [("timeout", r"(?i)time(d )?out|timeout"), ("lock", r"(?i)\block(ed)?\b"), ("unicode", r"(?i)unicode|latin|utf"), ("order", r"(?i)hash seed|ordering")]


@query(
    "WITH m AS (" + " UNION ALL ".join(f"SELECT id, '{i}' AS rule FROM cases WHERE regexp_matches(diagnosis, '{p}')" for i, p in _RULES) + ") SELECT id, rule, count(*) OVER (PARTITION BY id) > 1 AS ambiguous FROM m"
)
def rule_matches(spark, d):
    """Rules that match a diagnosis."""
    return R.rule_matches(_t(spark, d, "cases"), "id", "diagnosis", _RULES)


@query(
    f"SELECT experience_id, {_sql_goal('goal')} AS goal_key, {_COLLAPSE.format('lower(goal)')} AS curriculum_key, array_to_string((regexp_extract_all(lower(goal), '[a-z0-9]+'))[1:5], '_') AS first_words FROM ({_ONCE_E}) WHERE goal IS NOT NULL"
)
def goal_forms(spark, d):
    """Normalised forms of goals."""
    e = _once(_t(spark, d, "experiences"), "experience_id").where("goal IS NOT NULL")
    g = F.col("goal")
    words = F.array_join(F.slice(F.regexp_extract_all(F.lower(g), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 5), "_")
    return e.select("experience_id", X.normal_goal(g).alias("goal_key"), X.curriculum_goal(g).alias("curriculum_key"), words.alias("first_words"))


@query("SELECT id, array_to_string((list_distinct_ordered)[1:12], ' ') AS terms FROM (SELECT id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT id, list_filter(flatten(list_transform(list_reverse(string_split_regex(lower(error_excerpt), '\\r\\n|[\\n\\r]')), lambda y: regexp_extract_all(y, '[\\p{L}\\p{N}_]+'))), lambda x: length(x) >= 3) AS w FROM cases))")
def query_terms(spark, d):
    """Search terms of an excerpt."""
    return _t(spark, d, "cases").select("id", F.array_join(X.query_terms(F.col("error_excerpt")), " ").alias("terms"))


@query(f"SELECT id, sha256({_STRIP.format('error_excerpt')}) AS content_hash, 'case:' || substr(sha256('case|' || lower({_STRIP.format('error_excerpt')})), 1, 16) AS fingerprint FROM cases")
def fingerprints(spark, d):
    """Content hash and failure fingerprint of cases."""
    e = F.col("error_excerpt")
    return _t(spark, d, "cases").select("id", X.content_hash(e).alias("content_hash"), X.failure_fingerprint(F.lit("case"), e).alias("fingerprint"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?:^|[\\r\\n])[ \\t]*([^\\s][^\\r\\n]*)', 1), ''), NULL) AS first_line FROM documents WHERE text IS NOT NULL")
def first_lines(spark, d):
    """First line of every document that says something."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.first_line(F.col("text")).alias("first_line"))


@query("SELECT lower(lang) AS lang, count(*) AS n, count(text) AS with_text, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def corpus_by_language(spark, d):
    """Documents of every language label."""
    return _t(spark, d, "documents").groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"))


# ---- sequences -------------------------------------------------------------------------------------------------------


@query(
    f"WITH x AS (SELECT experience_id, unnest(actions) AS a, generate_subscripts(actions, 1) AS i FROM ({_ONCE_E})), m AS (SELECT *, CASE WHEN a IS DISTINCT FROM lag(a) OVER w THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY experience_id ORDER BY i)), "
    "g AS (SELECT *, sum(s) OVER (PARTITION BY experience_id ORDER BY i) AS k FROM m), l AS (SELECT experience_id, k, count(*) AS n FROM g GROUP BY 1, 2) SELECT experience_id, max(n) AS longest FROM l GROUP BY 1"
)
def longest_action_run(spark, d):
    """Longest run of one action in every experience that has any."""
    e = _once(_t(spark, d, "experiences"), "experience_id").where(F.size("actions") > 0)
    return e.select("experience_id", S.longest_run_in(F.col("actions")).cast("bigint").alias("longest"))


_EW = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    f"WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER {_EW} THEN 1 ELSE 0 END AS s FROM events), g AS (SELECT *, sum(s) OVER {_EW} AS k FROM m), l AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n) AS longest FROM l GROUP BY 1"
)
def longest_event_run(spark, d):
    """Longest run of one event type of every user."""
    return S.longest_run(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


@query("WITH m AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type <> 'error') AS x FROM events GROUP BY 1) SELECT e.user_id, count(*) FILTER (WHERE x IS NULL OR (ts, event_id) > x) AS tail FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1")
def tail_errors(spark, d):
    """Errors at the end of every user's events."""
    return S.tail_run(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@query(
    "WITH w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') OVER x AS f, count(DISTINCT CASE WHEN event_type = 'error' THEN props END) OVER x AS k FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) "
    "SELECT user_id, bool_or(f = 3 AND k >= 2) AS cycling FROM w GROUP BY 1"
)
def cycling_users(spark, d):
    """Users with three errors in a row of at least two kinds."""
    return S.cycling(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", "props", window=3)


@query(
    "WITH m AS (SELECT *, CASE WHEN event_type = 'error' THEN props END AS error FROM events), p AS (SELECT *, last_value(error IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m), "
    f"n AS (SELECT *, CASE WHEN error IS NOT NULL AND error IS DISTINCT FROM prev THEN 1 ELSE 0 END AS s FROM p), g AS (SELECT *, sum(s) OVER {_EW} AS island FROM n) "
    "SELECT user_id, island::BIGINT AS island, max(CASE WHEN s = 1 THEN error END) AS error, bool_or(event_type = 'purchase') AS resolved FROM g WHERE island BETWEEN 1 AND 5 GROUP BY 1, 2"
)
def error_islands(spark, d):
    """First five error segments of every user, and whether a purchase resolved each."""
    e = _t(spark, d, "events")
    error = F.when(F.col("event_type") == "error", F.col("props"))
    return S.error_islands(e, "user_id", [F.col("ts"), F.col("event_id")], error, F.col("event_type") == "purchase")


@query(
    f"WITH t AS (SELECT traj_id, list_transform(steps, lambda s: s.tool) AS tools, list_position(list_transform(steps, lambda s: s.tool = 'run_tests' AND NOT coalesce(s.ok, true)), true) AS k FROM ({_ONCE_T})) SELECT traj_id, list_contains(tools[k + 1:k + 2], 'read_file') AS read_next FROM t WHERE k > 0"
)
def read_after_failure(spark, d):
    """Whether a file is read within two steps after the first failing test run."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").withColumn("tools", F.transform("steps", lambda s: s["tool"]))
    first = S.first_where_in(F.col("steps"), lambda s: (s["tool"] == "run_tests") & ~F.coalesce(s["ok"], F.lit(True))).cast("int")
    return t.withColumn("k", first).where("k > 0").select("traj_id", S.followed_by_in(F.col("tools"), F.col("k"), "read_file", 2).alias("read_next"))


_WRITES, _READS = ["write_file", "edit_file", "apply_patch"], ["read_file", "list_directory", "search_code", "fetch_page"]


@query(
    f"WITH t AS (SELECT traj_id, steps, list_position(list_transform(steps, lambda s: s.tool IN {tuple(_WRITES)}), true) AS w FROM ({_ONCE_T}) WHERE len(steps) > 0), h AS (SELECT traj_id, CASE WHEN w > 0 THEN steps[1:w - 1] ELSE steps END AS head FROM t), "
    f"r AS (SELECT traj_id, head, coalesce(list_max(list_transform(head, lambda s, i: CASE WHEN s.tool IN {tuple(_READS)} THEN i ELSE 0 END)), 0) AS last FROM h), k AS (SELECT traj_id, list_filter(head[1:last], lambda s: coalesce(s.ok, false)) AS kept FROM r) "
    "SELECT traj_id, CASE WHEN len(kept) >= 2 THEN len(kept) ELSE 0 END AS kept FROM k"
)
def prefix_before_write(spark, d):
    """Steps kept of every trajectory before its first write."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").where(F.size("steps") > 0)
    kept = S.prefix_before_in(F.col("steps"), lambda s: s["tool"].isin(_WRITES), lambda s: s["tool"].isin(_READS), lambda s: s["ok"])
    return t.select("traj_id", F.size(kept).cast("bigint").alias("kept"))


@query(
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem) "
    "SELECT l_orderkey, pos, count(*) FILTER (WHERE l_linestatus = 'F') OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM l"
)
def cut_remap(spark, d):
    """Kept lines before every line of an order."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = _t(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint"))
    return S.kept_before(lines, "l_orderkey", [F.col("pos")], F.col("l_linestatus") == "F").select("l_orderkey", "pos", "cut")


@query(
    f"WITH r AS (SELECT traj_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY curated_at, traj_id) AS round, min(traj_id) OVER (PARTITION BY session_id) AS f FROM ({_ONCE_T}) WHERE session_id IS NOT NULL), "
    "o AS (SELECT *, row_number() OVER (ORDER BY round, f, session_id) AS n FROM r) SELECT traj_id, session_id, round FROM o WHERE n <= 300"
)
def round_robin_cap(spark, d):
    """A fair draw of 300 trajectories over sessions."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").where("session_id IS NOT NULL").select("traj_id", "session_id", "curated_at")
    return S.round_robin(t, "session_id", [F.col("curated_at"), F.col("traj_id")], 300, F.col("traj_id")).select("traj_id", "session_id", F.col("round").cast("bigint").alias("round"))


@query(
    f"SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events"
)
def previous_view(spark, d):
    """The nearest earlier view of every event."""
    e = R.previous_where(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "view", F.col("event_id"), "last_view")
    return e.select("event_id", "user_id", "last_view")


@query(
    f"WITH t AS ({_ONCE_T}), a AS (SELECT traj_id, unnest(actions) AS action, generate_subscripts(actions, 1) AS pos FROM t), s AS (SELECT traj_id, unnest(list_transform(steps, lambda x: x.tool)) AS tool, generate_subscripts(steps, 1) AS pos FROM t) "
    "SELECT traj_id, pos, action, tool, action = tool AS same FROM a JOIN s USING (traj_id, pos)"
)
def positional_zip(spark, d):
    """Actions and captured steps by position."""
    t = _once(_t(spark, d, "trajectories"), "traj_id")
    a = t.select("traj_id", F.posexplode("actions").alias("pos", "action"))
    s = t.select("traj_id", F.posexplode(F.transform("steps", lambda x: x["tool"])).alias("pos", "tool"))
    z = R.zip_positions(a, s, "traj_id", "pos")
    return z.select("traj_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "action", "tool", (F.col("action") == F.col("tool")).alias("same"))


@query(
    "WITH e AS (SELECT DISTINCT user_id % 10 AS team, user_id, event_type FROM events), n AS (SELECT team, event_type, count(*) AS n FROM e GROUP BY 1, 2) SELECT a.team, a.event_type AS one, b.event_type AS other, a.n * b.n AS pairs FROM n a JOIN n b ON a.team = b.team AND a.event_type < b.event_type"
)
def pair_disagreement(spark, d):
    """Pairs of users of a team with different events."""
    e = _t(spark, d, "events").select((F.col("user_id") % 10).alias("team"), "user_id", "event_type")
    return R.disagreeing_pairs(e, "team", "user_id", "event_type")


# ---- records and runs ------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT doc_id, round(1 - n / (SELECT count(*) FROM documents), 4) AS diversity FROM documents d JOIN n ON d.source IS NOT DISTINCT FROM n.source AND d.lang IS NOT DISTINCT FROM n.lang")
def diversity(spark, d):
    """Rarity of every document's source and language."""
    return A.rarity(_t(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"]).select("doc_id", "diversity")


_HAS = "length({}) > 0"
_RUNS = "(SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT a, i - row_number() OVER (PARTITION BY a ORDER BY i) AS g FROM (SELECT unnest(actions) AS a, generate_subscripts(actions, 1) AS i)) GROUP BY a, g))"
_UNSAFE = " OR ".join(f"regexp_matches({_SCAN}, '{p}')" for _, p in X.DESTRUCTIVE)
_PENALTIES = f"""SELECT *, coalesce({_RUNS}, 0) AS run, coalesce(try_cast(context->>'$.tool_count' AS BIGINT), len(actions)) AS tools, starts_with(coalesce(goal, ''), '{P.PLACEHOLDER}') AS empty,
    list_filter(string_split_regex(lower(coalesce(goal, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS words FROM ({_ONCE_E})"""


@query(
    f"""WITH p AS ({_PENALTIES}), l AS (SELECT experience_id, [CASE WHEN run > 3 THEN {{'d': 'efficiency', 'r': 'same action repeated ' || run || 'x consecutively'}} END, CASE WHEN tools > 30 THEN {{'d': 'efficiency', 'r': 'tool_count ' || tools || ' exceeds 30'}} END,
    CASE WHEN tools > 15 AND NOT coalesce(length(failure) > 0, false) AND NOT coalesce(length(resolution) > 0, false) THEN {{'d': 'efficiency', 'r': 'large tool usage captured no failure/fix signal'}} END, CASE WHEN empty THEN {{'d': 'clarity', 'r': 'placeholder goal'}} WHEN len(words) < 3 THEN {{'d': 'clarity', 'r': 'goal under 3 words'}} END] AS l FROM p)
    SELECT experience_id, x.d AS dimension, x.r AS reason FROM (SELECT experience_id, unnest(list_filter(l, lambda x: x IS NOT NULL)) AS x FROM l)"""
)
def soft_penalties(spark, d):
    """What takes from the quality of every experience, with reasons."""
    e = P.with_penalties(_once(_t(spark, d, "experiences"), "experience_id")).select("experience_id", F.explode("penalties").alias("p"))
    return e.select("experience_id", "p.dimension", "p.reason")


_QUALITY = f"""WITH p AS ({_PENALTIES}), n AS (SELECT *, (run > 3)::INT + (tools > 30)::INT + (tools > 15 AND NOT coalesce(length(failure) > 0, false) AND NOT coalesce(length(resolution) > 0, false))::INT AS docked FROM p),
    q AS (SELECT *, CAST([CASE WHEN outcome = 'failed' THEN 0.0 WHEN coalesce(verification.ok, false) OR coalesce(list_bool_or(list_transform(verification.attempts, lambda a: coalesce(a.ok, false))), false) THEN 1.0 END,
    CASE WHEN length(failure) > 0 AND (length(resolution) > 0 OR length(diagnosis) > 0) THEN 1.0 WHEN length(failure) > 0 THEN 0.25 END, CASE WHEN len(actions) > 0 THEN least(1.0, len(list_distinct(actions)) / 4.0) ELSE 0.0 END, greatest(0.0, 1.0 - 0.2 * docked),
    CASE WHEN empty THEN 0.25 WHEN len(words) < 3 THEN 0.7 ELSE 1.0 END, CASE WHEN coalesce(goal, '') = '' THEN 0.0 WHEN empty THEN 0.2 ELSE 0.4 END + CASE WHEN len(actions) > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN coalesce(context->>'$.message_count', context->>'$.part_count', context->>'$.tool_count') IS NOT NULL THEN 0.3 ELSE 0.0 END,
    CASE WHEN {_UNSAFE} THEN NULL WHEN outcome = 'success' THEN CASE WHEN len(actions) > 0 THEN 1.0 ELSE 0.0 END WHEN outcome = 'failed' THEN 0.0 END, CASE WHEN length(failure) > 0 THEN 0.5 END, NULL,
    CASE WHEN empty THEN 0.25 ELSE least(1.0, len(list_filter(words, lambda w: w NOT IN ('{"', '".join(X.STOPWORDS)}'))) / 5.0) END] AS DOUBLE[]) AS dims FROM n),
    s AS (SELECT *, round(list_sum(list_filter(dims, lambda x: x IS NOT NULL)) / len(list_filter(dims, lambda x: x IS NOT NULL)), 4) AS score, list_filter({P.DIMENSIONS}, lambda x, i: dims[i] IS NULL) AS unknown FROM q)"""


@query(f"{_QUALITY} SELECT experience_id, score AS overall, array_to_string(unknown, ',') AS unknown FROM s")
def quality_score(spark, d):
    """Mean of the quality dimensions that are known, and the names of the others."""
    e = P.with_quality(_once(_t(spark, d, "experiences"), "experience_id"))
    return e.select("experience_id", F.col("score").alias("overall"), F.array_join("unknown", ",").alias("unknown"))


@query(f"SELECT {_sql_goal('goal')} AS goal_key, arg_max(experience_id, (coalesce(confidence, 0), recorded_at, experience_id)) AS winner, sum(times_seen)::BIGINT AS times_seen, count(*) - 1 AS absorbed FROM ({_ONCE_E}) GROUP BY 1")
def goal_merge(spark, d):
    """One winner for every normalised goal."""
    e = _once(_t(spark, d, "experiences"), "experience_id")
    return A.merge_goals(e, "goal", [F.coalesce("confidence", F.lit(0.0)), F.col("recorded_at"), F.col("experience_id")], "experience_id", "times_seen")


@query(f"SELECT experience_id, row_number() OVER (PARTITION BY {_sql_goal('goal')} ORDER BY recorded_at DESC, experience_id DESC) > 1 AS superseded FROM ({_ONCE_E})")
def superseded_goals(spark, d):
    """Experiences that a later one with the same goal supersedes."""
    e = _once(_t(spark, d, "experiences"), "experience_id")
    e = e.withColumn("goal", F.coalesce("goal", F.lit("")))
    return A.newest_per_goal(e, "goal", [F.col("recorded_at"), F.col("experience_id")]).select("experience_id", "superseded")


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(eligibility_reasons) AS reason FROM ({_ONCE_T})) GROUP BY 1")
def reason_tally(spark, d):
    """Recorded reasons of trajectories."""
    return A.exploded_tally(_once(_t(spark, d, "trajectories"), "traj_id"), "eligibility_reasons", "reason")


@query(f"SELECT verdict, outcome, trajectory_class, count(*) AS n FROM ({_ONCE_T}) GROUP BY 1, 2, 3")
def verdict_crosstab(spark, d):
    """Verdicts by outcome and class."""
    return _once(_t(spark, d, "trajectories"), "traj_id").groupBy("verdict", "outcome", "trajectory_class").agg(F.count("*").alias("n"))


@query(f"SELECT tag, count(*) AS n, count(DISTINCT experience_id) AS records FROM (SELECT experience_id, unnest(tags) AS tag FROM ({_ONCE_E})) GROUP BY 1")
def tag_vocabulary(spark, d):
    """All tags with their uses."""
    rows = _once(_t(spark, d, "experiences"), "experience_id").select("experience_id", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("experience_id").alias("records"))


@query(f"SELECT action, count(*) AS n FROM (SELECT unnest(actions) AS action FROM ({_ONCE_E})) GROUP BY 1")
def action_histogram(spark, d):
    """Uses of every action."""
    return A.exploded_tally(_once(_t(spark, d, "experiences"), "experience_id"), "actions", "action")


@query(f"SELECT t.traj_id, e.experience_id, e.outcome AS recorded, t.outcome AS curated, round(t.provenance.overall_score, 4) AS score FROM ({_ONCE_T}) t JOIN ({_ONCE_E}) e ON t.provenance.experience_id = e.experience_id")
def trajectory_provenance(spark, d):
    """Trajectories with the experience they come from."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").select("traj_id", F.col("outcome").alias("curated"), "provenance")
    e = _once(_t(spark, d, "experiences"), "experience_id").select("experience_id", F.col("outcome").alias("recorded"))
    return t.join(e, F.col("provenance.experience_id") == F.col("experience_id")).select("traj_id", "experience_id", "recorded", "curated", F.round("provenance.overall_score", 4).alias("score"))


@query(
    f"SELECT 'cases' AS source, count(*) AS pairs FROM cases WHERE length(diagnosis) > 0 AND signature NOT IN (SELECT signature FROM holdout WHERE signature IS NOT NULL) UNION ALL SELECT 'documents', count(*) FROM documents WHERE length({_STRIP.format('text')}) > 0 "
    f"UNION ALL SELECT 'experiences', count(*) FROM ({_ONCE_E}) WHERE length(resolution) > 0"
)
def training_pairs(spark, d):
    """Pairs that each source gives."""
    cases = R.exclude(_t(spark, d, "cases"), "signature", _t(spark, d, "holdout"), "signature").where(X.present(F.col("diagnosis"))).select(F.lit("cases").alias("source"))
    docs = _t(spark, d, "documents").where(X.present(X.strip(F.col("text")))).select(F.lit("documents").alias("source"))
    e = _once(_t(spark, d, "experiences"), "experience_id").where(X.present(F.col("resolution"))).select(F.lit("experiences").alias("source"))
    return A.tally(cases.union(docs).union(e), "source", "pairs")


@query(
    f"SELECT source, day, count(*) AS n, sum(tools)::BIGINT AS tools FROM (SELECT context->>'$.source' AS source, substr(recorded_at, 1, 10) AS day, (context->>'$.tool_count')::BIGINT AS tools FROM ({_ONCE_E})) GROUP BY ROLLUP (source, day)"
)
def miner_rollup(spark, d):
    """Experiences by source and day with totals."""
    e = _once(_t(spark, d, "experiences"), "experience_id")
    rows = e.select(F.get_json_object("context", "$.source").alias("source"), F.substring("recorded_at", 1, 10).alias("day"), F.get_json_object("context", "$.tool_count").cast("bigint").alias("tools"))
    return rows.rollup("source", "day").agg(F.count("*").alias("n"), F.sum("tools").alias("tools"))


_RUN = "SELECT o_orderpriority AS model, o_orderstatus AS task, year(o_orderdate) AS run, o_totalprice > 250000 AS success, o_custkey % 25 AS iterations, o_totalprice / 1000 AS duration FROM orders"


def _runs(spark, d):
    o = _t(spark, d, "orders")
    return o.select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("task"), F.year("o_orderdate").cast("bigint").alias("run"), (F.col("o_totalprice") > 250000).alias("success"), (F.col("o_custkey") % 25).alias("iterations"), (F.col("o_totalprice") / 1000).alias("duration")
    )


@query(f"SELECT model, count(*) AS tasks, count(*) FILTER (WHERE success) AS successes, round(count(*) FILTER (WHERE success) / count(*), 3) AS rate, round(avg(iterations), 1) AS avg_iterations, round(avg(duration), 1) AS avg_duration FROM ({_RUN}) GROUP BY 1")
def eval_aggregates(spark, d):
    """Metrics of each model over all runs."""
    return A.run_metrics(_runs(spark, d), ["model"])


@query(
    f"WITH r AS (SELECT model, task, run, count(*) FILTER (WHERE success) * 2 >= count(*) AS success FROM ({_RUN}) GROUP BY 1, 2, 3) SELECT a.model, a.task, a.run, CASE WHEN a.success THEN 'regression' ELSE 'improvement' END AS change FROM r a JOIN r b ON a.model = b.model AND a.task = b.task AND b.run = a.run + 1 WHERE a.success <> b.success"
)
def eval_compare(spark, d):
    """Changes of each model and task from one year's run to the next."""
    r = _runs(spark, d).groupBy("model", "task", "run").agg((F.count_if("success") * 2 >= F.count("*")).alias("success"))
    return A.compare_runs(r, r.withColumn("run", F.col("run") - 1), ["model", "task", "run"])


@query(f"WITH r AS ({_RUN}), m AS (SELECT DISTINCT model FROM r), y AS (SELECT DISTINCT run FROM r) SELECT model, run, count(task) AS tasks FROM m CROSS JOIN y LEFT JOIN r USING (model, run) GROUP BY 1, 2")
def eval_matrix(spark, d):
    """Tasks of every model in every year, zero included: a few models by a few years, counted before they are crossed."""
    r = _runs(spark, d)
    n = r.groupBy("model", "run").agg(F.count("task").alias("tasks"))
    grid = n.select("model").distinct().crossJoin(F.broadcast(n.select("run").distinct()))  # years: bounded
    return grid.join(n, ["model", "run"], "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))


@query("SELECT doc_id, CASE WHEN length(text) IS NULL THEN 'removed' WHEN contains(text, 'stale') THEN 'changed' END AS change FROM documents WHERE text IS NULL OR contains(text, 'stale')")
def ledger_changes(spark, d):
    """Documents that change or leave when every 'stale' is replaced and null texts go."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    ledger = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    scan = docs.where("text IS NOT NULL").select("doc_id", F.sha2(F.replace("text", F.lit("stale"), F.lit("fresh")), 256).alias("h"))
    return R.changed(ledger, scan, "doc_id", "h")


@query(
    rf"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, string_split(regexp_replace(chr(10) || replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n#', chr(1) || '#', 'g'), chr(1)) AS parts FROM documents), p AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS pos FROM d),
    s AS (SELECT doc_id, pos, CASE WHEN starts_with(x, '#') THEN regexp_extract(x, '^#+([^\n]*)', 1) END AS h, CASE WHEN starts_with(x, '#') THEN regexp_replace(x, '^#[^\n]*\n?', '') ELSE x END AS c FROM p), k AS (SELECT doc_id, pos, coalesce(nullif({_STRIP.format('h')}, ''), doc_id) AS heading, {_STRIP.format('c')} AS content FROM s WHERE {_STRIP.format('c')} <> '')
    SELECT * FROM k UNION ALL SELECT doc_id, 0, doc_id, '(empty document)' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k)"""
)
def document_sections(spark, d):
    """Sections of every document."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return T.markdown_sections(docs, "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    rf"""WITH l AS (SELECT experience_id, string_split_regex(coalesce(failure, ''), '\r\n|\n') AS ls FROM ({_ONCE_E})), r AS (SELECT experience_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
    f AS (SELECT experience_id, pos, regexp_extract(line, '(?i)^(?:FAIL|ERROR)[:\s]+(.+)$', 1) AS m, right(array_to_string(ls[1:pos], chr(10)) || chr(10), 500) AS b FROM r WHERE regexp_matches(line, '(?i)^(?:FAIL|ERROR)[:\s]+[^\s]')),
    n AS (SELECT *, coalesce(nullif(regexp_extract(b, '{T.TEST_NAME}', 1), ''), nullif(regexp_extract(b, '{T.TEST_NAME}', 2), ''), 'unknown_test') AS name FROM f)
    SELECT experience_id, pos, {_sql_canonical(_STRIP.format("name") + " || ' :: ' || " + _STRIP.format("m"))} AS signature, substr({_STRIP.format('m')}, 1, 4000) AS error_excerpt, '{T.PENDING}' AS diagnosis FROM n"""
)
def transcript_cases(spark, d):
    """Failures mined from recorded failure texts."""
    found = T.transcript_cases(_once(_t(spark, d, "experiences"), "experience_id"), "experience_id", "failure")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


_ERROR = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(body, '{p}') THEN {_STRIP.format(f"regexp_extract(body, '{p}', 1)")} END" for p in T.ERROR_LINES) + ")"
_BARE = r"regexp_replace({}, '\.+$', '')"
_STATED = ", ".join("CASE WHEN length({0}) > 20 THEN {0} END".format(_BARE.format(_STRIP.format(f"regexp_extract(body, '{p}', 1)"))) for p in T.DIAGNOSES)
_SAYS = " AND ".join(["length(x) > 40", *(f"NOT starts_with(x, '{w}')" for w in T.NO_DIAGNOSIS[0]), *(f"NOT contains(x, '{w}')" for w in T.NO_DIAGNOSIS[1])])


@query(
    rf"""WITH d AS (SELECT doc_id, string_split(chr(10) || coalesce(text, ''), chr(10) || '## ') AS parts FROM documents), p AS (SELECT doc_id, unnest(parts[2:]) AS s, generate_subscripts(parts[2:], 1) - 1 AS pos FROM d),
    t AS (SELECT doc_id, pos, {_STRIP.format("regexp_extract(s, '^([^\n]*)', 1)")} AS title, regexp_replace(s, '^[^\n]*\n?', '') AS body FROM p), e AS (SELECT doc_id, pos, title, body, {_STRIP.format("regexp_replace(regexp_replace(title, '\\[.+\\]', '', 'g'), '^D-\\d+\\s*', '')")} AS name, {_ERROR} AS error FROM t WHERE regexp_matches(title || ' ' || body, '{T.FAILURE_WORDS}')),
    g AS (SELECT *, coalesce({_STATED}, {_BARE.format(f"list_filter(list_transform(string_split(body, chr(10)), lambda y: {_STRIP.format('y')}), lambda x: {_SAYS})[1]")}) || '.' AS diagnosis FROM e)
    SELECT doc_id, pos, {_sql_canonical("name || ' :: ' || coalesce(error, lower(name))")} AS signature, substr(coalesce(error, title), 1, 4000) AS error_excerpt, substr(diagnosis, 1, 4000) AS diagnosis FROM g WHERE diagnosis IS NOT NULL"""
)
def decision_cases(spark, d):
    """Cases mined from decision sections of documents."""
    return T.decision_cases(_t(spark, d, "documents"), "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"SELECT traj_id, pos, tool, '[TOOL: ' || tool || '(path=\"' || (args->>'$.path') || '\")]' AS rendered FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).args AS args, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))"
)
def rendered_calls(spark, d):
    """Captured steps as tool-call text."""
    s = _once(_t(spark, d, "trajectories"), "traj_id").select("traj_id", F.posexplode("steps").alias("pos", "s"))
    args = F.from_json("s.args", "map<string,string>")
    return s.select("traj_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("s.tool").alias("tool"), render_call(F.col("s.tool"), args).alias("rendered"))


@query(f"SELECT traj_id, pos, tool, args->>'$.path' AS path FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).args AS args, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))")
def parsed_calls(spark, d):
    """Tool-call text parsed back into name and argument."""
    r = rendered_calls(spark, d).select("traj_id", "pos", F.explode(calls_of(F.col("rendered"))).alias("c"))
    return r.select("traj_id", "pos", F.col("c.name").alias("tool"), F.col("c.args")["path"].alias("path"))


_ESC = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
_PAGE_TEXT = r"trim(regexp_replace(text, '[\s\p{Z}\x1C-\x1F\x{0085}]+', ' ', 'g'))"


@query(
    f"SELECT doc_id, trim(coalesce(heading, '')) AS title, least(length({_PAGE_TEXT}) + CASE WHEN length({_PAGE_TEXT}) > 0 THEN 1 ELSE 0 END + 9, 20000) AS text_chars, length({_PAGE_TEXT}) + 10 > 20000 AS truncated, 2 AS n_links, 'https://base.example/a/doc/' || doc_id AS first_url, 'More here' AS label FROM documents WHERE text IS NOT NULL"
)
def page_links(spark, d):
    """Title, visible text and links of documents set as HTML pages: scripts are no text, addresses are made whole."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    link = F.concat(F.lit('<a href="doc/'), F.col("doc_id").cast("string"), F.lit('">More here</a><a href="https://other.example/"></a>'))
    html = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("heading", F.lit(""))), F.lit("</title><script>var x = 1;</script></head><body><p>"), esc(F.col("text")), F.lit("</p>"), link, F.lit("</body></html>"))
    pages = extract_pages(docs.select("doc_id", html.alias("html"), F.lit("https://base.example/a/").alias("url")), "doc_id", "url", "html")
    first = F.col("links")[0]
    return pages.select("doc_id", "title", F.length("text").cast("bigint").alias("text_chars"), "truncated", F.size("links").alias("n_links"), first["url"].alias("first_url"), first["text"].alias("label"))


def _facts(spark: SparkSession, d: str, *suffixes: str) -> DataFrame:
    suffix = F.explode(F.array(*(F.lit(f".{s}") for s in suffixes))).alias("suffix")
    docs = _t(spark, d, "documents").select("doc_id", "text", suffix)
    return extract_code(docs.withColumn("path", F.concat(F.col("doc_id").cast("string"), "suffix")), "path", "text")


_SOURCE_LINES = r"string_split_regex(regexp_replace(text, '(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]')"
_W, _S = r"[\p{L}\p{N}_]", r"[\s\p{Z}]"


def _sql_facts(suffix: str, language: str, defined: str, kind: str, module: str = "NULL") -> str:
    """SQL of the facts of documents read line by line: definitions, imports and other words."""
    return (
        f"WITH d AS (SELECT doc_id || '.{suffix}' AS path, {_SOURCE_LINES} AS l FROM documents WHERE length(text) > 0), r AS (SELECT path, unnest(l) AS x, generate_subscripts(l, 1)::INT AS line FROM d), k AS (SELECT path, line, x, {defined} AS f, {kind} AS kind, {module} AS m FROM r) "
        f"SELECT path, 'definition' AS fact, f AS name, kind, line, '{language}' AS detail FROM k WHERE f <> '' UNION ALL SELECT path, 'import', m, 'module', line, '' FROM k WHERE m <> '' "
        f"UNION ALL SELECT path, 'reference', w, 'word', line, '{language}' FROM (SELECT path, line, f, unnest(regexp_extract_all(x, '[A-Za-z_]{_W}*')) AS w FROM k) WHERE w IS DISTINCT FROM f"
    )


def _first_form(forms: list[tuple[str, str]], group: bool) -> str:
    """SQL of the name, or the kind, that the first fitting form gives."""
    form = lambda p: p.replace(r"\w", _W).replace(r"\s", _S).replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{form(p)}') THEN " + (f"regexp_extract(x, '{form(p)}', 1)" if group else f"'{k}'") for k, p in forms) + " END"


@query(_sql_facts("txt", "text", _first_form([("symbol", OTHER_FORM.pattern)], True), "'symbol'"))
def code_facts(spark, d):
    """Definitions and references in documents read as source text of no known language."""
    return _facts(spark, d, "txt")


@query()
def python_facts(spark, d):
    """Definitions, references, imports and diagnostics of documents read as Python."""
    return _facts(spark, d, "py")


@query(
    _sql_facts("js", "javascript", _first_form([(k, f.pattern) for k, f in SCRIPT_FORMS], True), _first_form([(k, f.pattern) for k, f in SCRIPT_FORMS], False), _first_form([("module", SCRIPT_IMPORT.pattern)], True))
)
def script_facts(spark, d):
    """Definitions, references and imports of documents read as JavaScript."""
    return _facts(spark, d, "js")


@query()
def code_definitions(spark, d):
    """Functions, classes and symbols in the name of which 'load' stands, in documents read in any of the three ways."""
    return definitions(_facts(spark, d, "txt", "py", "js"), "load", exact=False)


@query()
def code_references(spark, d):
    """Places that use 'load', in documents read in any of the three ways."""
    return references(_facts(spark, d, "txt", "py", "js"), "load")


@query()
def code_importers(spark, d):
    """Documents that import 'os' or what is inside it, read as Python or as JavaScript."""
    return importers(_facts(spark, d, "py", "js"), "os")


@query("SELECT count(*) AS lines, count(DISTINCT id) AS ids FROM cases")
def canonical_export(spark, d):
    """The case base as canonical JSON lines, counted and read back."""
    c = canonical_lines(_t(spark, d, "cases"), ["id"])
    return c.agg(F.count("*").alias("lines"), F.count_distinct(F.get_json_object("line", "$.id")).alias("ids"))


# Sides by a data column: what was last seen in the earlier half of the year and in the later one, and who confirmed it.
_EARLY = f"{_ts('last_seen')} < TIMESTAMP '2031-07-01'"


def _halves(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    early = X.epoch(X.parse_stamp(F.col("last_seen"))) < 1940630400
    return cases.where(early), cases.where(~early)


@query(
    f"WITH k AS (SELECT id, {_SUBJECT} AS category, merged_from IS NOT NULL AS early FROM cases), g AS (SELECT category, count(k.id) FILTER (WHERE early) AS before, count(k.id) AS after FROM {_ALL} LEFT JOIN k USING (category) GROUP BY 1) "
    "SELECT category, before, after, CASE WHEN before = 0 THEN 'empty' WHEN before < 3 THEN 'thin' ELSE 'covered' END AS was, CASE WHEN after = 0 THEN 'empty' WHEN after < 3 THEN 'thin' ELSE 'covered' END AS \"is\" FROM g WHERE after > before AND was <> \"is\""
)
def gap_fill(spark, d):
    """Categories that cases which nothing was merged into filled."""
    cases = _t(spark, d, "cases")
    return A.gap_changes(cases.where("merged_from IS NOT NULL"), cases).select("category", "before", "after", "was", "is")


@query(
    f"WITH g AS (SELECT {_CLUSTER} AS k, count(*) AS n, min(id) AS a, max(id) AS b FROM cases GROUP BY 1 HAVING count(*) >= 2 AND k <> '') SELECT a AS first_id, b AS last_id FROM g WHERE a NOT IN (SELECT id FROM cases WHERE confirmed_by IS NULL)"
)
def reject_filter(spark, d):
    """Clusters that weren't rejected; those whose first case nobody confirmed count as rejected, their members in reverse."""
    cases = _t(spark, d, "cases")
    found = A.clusters(cases, "error_excerpt").select(F.lit("cluster").alias("type"), F.array("first_id", "last_id").alias("supporting_cases"), "first_id", "last_id")
    rejected = found.join(cases.where("confirmed_by IS NULL").select(F.col("id").alias("first_id")), "first_id", "left_semi")
    return R.unrejected(found, rejected.select("type", F.reverse("supporting_cases").alias("supporting_cases"))).select("first_id", "last_id")


@query(
    f"WITH c AS (SELECT id AS line, signature, {_EARLY} AS early FROM cases), i AS (SELECT line, signature FROM c WHERE NOT early), f AS (SELECT signature, min(line) AS first FROM i GROUP BY 1) "
    "SELECT line, signature, CASE WHEN line > first THEN 'in file' ELSE 'live' END AS kind FROM i JOIN f USING (signature) WHERE line > first OR signature IN (SELECT signature FROM c WHERE early)"
)
def import_conflicts(spark, d):
    """Cases of the later half of the year that repeat one another or the earlier half."""
    early, late = _halves(_t(spark, d, "cases").select(F.col("id").alias("line"), "signature", "last_seen"))
    return C.duplicate_split(late, early, "signature", "line")


@query(
    f"WITH c AS (SELECT signature, diagnosis, {_EARLY} AS early FROM cases), a AS (SELECT signature, count(*) AS s, max(diagnosis) AS h FROM c WHERE early GROUP BY 1), b AS (SELECT signature, count(*) AS s, max(diagnosis) AS h FROM c WHERE NOT early GROUP BY 1) "
    "SELECT signature, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'unlisted' WHEN a.s <> b.s THEN 'size drift' WHEN a.h IS DISTINCT FROM b.h THEN 'hash drift' ELSE 'same' END AS status FROM a FULL JOIN b USING (signature)"
)
def manifest_diff(spark, d):
    """Status of signatures between the two halves of the year: cases as size, last diagnosis in order as digest."""
    before, after = (h.groupBy("signature").agg(F.count("*").alias("s"), F.max("diagnosis").alias("h")) for h in _halves(_t(spark, d, "cases")))
    return R.full_diff(before, after, "signature", "s", "h")


# ---- checks ----------------------------------------------------------------------------------------------------------


@query(
    "SELECT id, len(m) AS missing FROM (SELECT id, list_filter(['shard', 'probe', 'retries'], lambda f: NOT contains(lower(coalesce(diagnosis, '')), f)) AS m FROM cases)"
)
def fact_gate(spark, d):
    """How many of three facts every diagnosis lacks."""
    facts = F.array(F.lit("shard"), F.lit("probe"), F.lit("retries"))
    return _t(spark, d, "cases").select("id", F.size(C.facts_missing(F.col("diagnosis"), facts)).cast("bigint").alias("missing"))


@query(
    "WITH s AS (SELECT *, l_quantity <= 45 AND l_linestatus = 'F' AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem), "
    "m AS (SELECT *, coalesce(bool_or(NOT good AND l_returnflag <> 'R') OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop FROM s) SELECT l_orderkey, pos, CASE WHEN NOT stop THEN good END AS ok FROM m"
)
def verification_skip(spark, d):
    """Order lines as verification steps: good, failed, or skipped after the first failure that counts."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    s = _t(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint"))
    s = s.select(
        "l_orderkey", "pos", F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("exit_code"), F.lit(0).alias("want_exit"), F.col("l_linestatus").alias("output"),
        F.lit("F").alias("must_contain"), F.lit(None).cast("string").alias("must_not_contain"), (F.col("l_returnflag") == "R").alias("optional"),
    )
    return C.verified_steps(s, "l_orderkey", "pos").select("l_orderkey", "pos", "ok")


@query(
    f"WITH t AS (SELECT steps, list_position(list_transform(steps, lambda s: s.tool IN ('write_file', 'edit_file', 'apply_patch')), true) AS w, list_position(list_transform(steps, lambda s: s.tool = 'read_file'), true) AS r FROM ({_ONCE_T}) WHERE len(steps) > 0) "
    "SELECT count(*) AS runs, round(avg(len(steps)), 4) AS mean_steps, round(sum(len(list_filter(steps, lambda s: NOT coalesce(s.ok, true)))) / sum(len(steps)), 4) AS failed_share, count(*) FILTER (WHERE steps[1].tool = 'list_directory') AS list_first, count(*) FILTER (WHERE w > 0 AND r > 0 AND r < w) AS read_before_write FROM t"
)
def protocol_metrics(spark, d):
    """How trajectories use their tools."""
    return C.protocol_metrics(_once(_t(spark, d, "trajectories"), "traj_id"), "steps")


@query(f"SELECT traj_id FROM ({_ONCE_T}) WHERE {_sql_goal('goal')} NOT IN (SELECT {_sql_goal('goal')} FROM ({_ONCE_E}) WHERE outcome = 'success' AND goal IS NOT NULL)")
def uncovered_goals(spark, d):
    """Trajectories whose goal no successful experience has."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").where("goal IS NOT NULL")
    return C.covered_goals(t, "goal", _once(_t(spark, d, "experiences"), "experience_id").where("goal IS NOT NULL"), "goal", F.col("outcome") == "success").select("traj_id")


@query(
    f"SELECT traj_id, pos, CASE WHEN tool LIKE 'run%' THEN 'ask' WHEN regexp_matches(tool, '^[a-z]+_file$') AND contains(lower(coalesce(args, '')), 'tests/') THEN 'allow' WHEN tool LIKE 'read%' THEN 'allow' ELSE 'deny' END AS decision "
    f"FROM (SELECT traj_id, unnest(steps).tool AS tool, unnest(steps).args AS args, generate_subscripts(steps, 1) AS pos FROM ({_ONCE_T}))"
)
def permission_rules(spark, d):
    """Decision of an ordered rule list for every captured step."""
    s = _once(_t(spark, d, "trajectories"), "traj_id").select("traj_id", F.posexplode("steps").alias("pos", "s")).select("traj_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "s.tool", "s.args")
    rules = [("run*", "", "ask"), ("*_file", "tests/", "allow"), ("read*", "", "allow")]
    return s.select("traj_id", "pos", C.glob_rules("tool", "args", rules, "deny").alias("decision"))


@query("WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s][^\\n]*')) AS line FROM documents) SELECT doc_id, count(*) AS n FROM s WHERE contains(lower(line), 'timeout') GROUP BY 1")
def relevant_lines(spark, d):
    """Lines of documents about timeouts."""
    rows = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(F.lower("line").contains("timeout")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '' AND contains(lower(x), 'timeout')) AS l FROM documents) SELECT doc_id, least(len(l), 10) AS n, array_to_string(list_transform(l[1:10], lambda x: substr(trim(x), 1, 400)), chr(10)) AS sentences FROM s WHERE len(l) > 0"""
)
def relevant_sentences(spark, d):
    """Sentences of documents about timeouts."""
    s = _t(spark, d, "documents").select("doc_id", C.relevant_sentences(F.col("text"), ["timeout"]).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_join("s", "\n").alias("sentences"))


@query(
    f"SELECT traj_id, 'Goal: ' || goal || chr(10) || string_agg(k || '. ' || s.tool || ' ' || coalesce(s.args, '{{}}') || ' -> ' || substr(coalesce(s.result_head, ''), 1, 160), chr(10) ORDER BY k) FILTER (WHERE k <= 6) AS text FROM (SELECT traj_id, goal, unnest(steps) AS s, generate_subscripts(steps, 1) AS k FROM ({_ONCE_T})) GROUP BY traj_id, goal"
)
def demonstrations(spark, d):
    """Trajectories as numbered demonstrations."""
    t = _once(_t(spark, d, "trajectories"), "traj_id").where(F.size("steps") > 0)
    return t.select("traj_id", C.render_demonstration(F.col("goal"), F.col("steps")).alias("text"))


# ---- pipelines -------------------------------------------------------------------------------------------------------


@query(
    "WITH u AS (SELECT 'case' AS source, id::VARCHAR AS key, times_seen::DOUBLE AS score, id AS o FROM cases WHERE contains(lower(concat_ws(' ', signature, diagnosis)), 'stale') OR contains(lower(concat_ws(' ', signature, diagnosis)), 'manifest') "
    "UNION ALL SELECT 'document', doc_id::VARCHAR, (contains(lower(concat_ws(' ', text, heading)), 'stale')::INT + contains(lower(concat_ws(' ', text, heading)), 'manifest')::INT) / 2, doc_id FROM documents), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, o) AS rank FROM u WHERE score > 0) SELECT source, key, score, rank FROM r WHERE rank <= 10"
)
def ask(spark, d):
    """Ten cases and ten documents for a question."""
    return P.retrieve(_t(spark, d, "cases"), _t(spark, d, "documents"), "stale manifest")


@query(
    rf"""WITH f AS (SELECT experience_id, nullif(regexp_extract(failure, '(?:^|[\r\n])[ \t]*([^\s][^\r\n]*)', 1), '') AS l FROM ({_ONCE_E})), s AS (SELECT experience_id, {_sql_canonical("l")} AS s, {_sql_norm("l")} AS e FROM f),
    a AS (SELECT signature AS s, id, diagnosis FROM cases QUALIFY row_number() OVER (PARTITION BY signature ORDER BY times_seen DESC, id) = 1), b AS (SELECT string_split(signature, ' :: ')[-1] AS e, id, diagnosis FROM cases WHERE string_split(signature, ' :: ')[-1] <> '' QUALIFY row_number() OVER (PARTITION BY string_split(signature, ' :: ')[-1] ORDER BY times_seen DESC, id) = 1)
    SELECT experience_id, CASE WHEN a.id IS NOT NULL THEN 'signature' WHEN b.id IS NOT NULL THEN 'error' ELSE 'none' END AS tier, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS case_id, CASE WHEN a.id IS NOT NULL THEN a.diagnosis ELSE b.diagnosis END AS diagnosis FROM s LEFT JOIN a USING (s) LEFT JOIN b USING (e)"""
)
def advise(spark, d):
    """Known diagnoses of recorded failures."""
    return P.advise(_once(_t(spark, d, "experiences"), "experience_id"), "experience_id", "failure", _t(spark, d, "cases"))


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_SCAN}, '{p}') THEN '{n}' END" for n, p in [*X.CREDENTIALS, *X.DESTRUCTIVE]) + "], lambda x: x IS NOT NULL)"


@query(
    f"""{_QUALITY}, g AS (SELECT context->>'$.source' AS source, project_type, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT *, {_sql_goal("coalesce(goal, '')")} AS goal_key, {_FLAGS} AS flags FROM s),
    k AS (SELECT goal_key, experience_id, score, flags, unknown, context->>'$.source' AS source, project_type, sum(times_seen) OVER (PARTITION BY goal_key)::BIGINT AS times_seen, count(*) OVER (PARTITION BY goal_key) - 1 AS absorbed FROM w QUALIFY row_number() OVER (PARTITION BY goal_key ORDER BY score DESC, experience_id) = 1)
    SELECT goal_key, experience_id, score, round(1 - g.n / (SELECT count(*) FROM s), 4) AS diversity, array_to_string(flags, ',') AS flags, array_to_string(unknown, ',') AS unknown, times_seen, absorbed FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source AND k.project_type IS NOT DISTINCT FROM g.project_type"""
)
def curate(spark, d):
    """Curated experiences by goal, whole rows."""
    c = P.curate(_t(spark, d, "experiences"))
    return c.withColumns({"flags": F.array_join("flags", ","), "unknown": F.array_join("unknown", ",")})


@query(
    f"""WITH e AS (SELECT * FROM ({_ONCE_E}) WHERE NOT ("""
    + " OR ".join(f"regexp_matches({_SCAN}, '{p}')" for _, p in [*X.CREDENTIALS, *X.DESTRUCTIVE])
    + """)) SELECT experience_id, 'failure' AS kind, substr(failure, 1, 200) AS lesson FROM e WHERE length(failure) > 0 AND length(diagnosis) > 0
    UNION ALL SELECT experience_id, 'procedure', array_to_string(list_sort(list_distinct(actions)), ',') FROM e WHERE outcome = 'success' AND len(actions) >= 3"""
)
def lessons(spark, d):
    """Failures and procedures that experiences teach."""
    return P.lessons(_t(spark, d, "experiences"))


@query(
    f"""WITH t AS (SELECT *, coalesce(list_contains(tags, 'demo') AND capture_tier = 'demonstration', false) AS d FROM ({_ONCE_T})), r AS (SELECT traj_id, {_sql_goal("coalesce(goal, '')")} AS g, session_id FROM t WHERE NOT d),
    k AS (SELECT traj_id, g, row_number() OVER (PARTITION BY g ORDER BY session_id NULLS FIRST, traj_id) AS round, min(traj_id) OVER (PARTITION BY g) AS f FROM r), o AS (SELECT traj_id, row_number() OVER (ORDER BY round, f, g) AS n FROM k)
    SELECT traj_id, 'deliberate' AS lane FROM t WHERE d UNION ALL SELECT traj_id, 'real' FROM o WHERE n <= 2 * (SELECT count(*) FROM t WHERE d) OR (SELECT count(*) FROM t WHERE d) = 0"""
)
def training_corpus(spark, d):
    """Demonstrations and a fair draw of other trajectories."""
    t = _t(spark, d, "trajectories")
    return P.training_corpus(t, F.array_contains("tags", "demo") & (F.col("capture_tier") == "demonstration"))


@query(
    f"WITH t AS ({_ONCE_T}), m AS (SELECT 'user' AS role, coalesce(goal, '') AS c FROM t UNION ALL SELECT 'assistant', '[TOOL: ' || s.tool || '(' || coalesce(s.args, '{{}}') || ')]' FROM (SELECT unnest(steps) AS s FROM t) UNION ALL SELECT 'user', coalesce(s.result_head, '') FROM (SELECT unnest(steps) AS s FROM t) "
    "UNION ALL SELECT 'assistant', final_answer FROM t WHERE length(final_answer) > 0), n AS (SELECT role, len(list_filter(regexp_split_to_array(c, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')) AS n FROM m) SELECT sum(n) FILTER (WHERE role = 'assistant')::BIGINT AS assistant, sum(n)::BIGINT AS words, round(assistant / words, 4) AS ratio FROM n"
)
def assistant_ratio(spark, d):
    """Share of words that assistants say in all chats."""
    return P.assistant_ratio(P.chat_records(_t(spark, d, "trajectories")))


# ---- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark, d, name):
    return spark.readStream.schema(_t(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _run_store(spark, stream) -> DataFrame:
    base = scratch(spark)
    stores.write_store(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    return stores.read_store(spark, f"{base}/rows")


_KEY = "'user ' || user_id || ' :: ' || props"


@query(f"SELECT {_KEY} AS signature, count(*) AS times_seen, floor(epoch(max(ts)))::BIGINT AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_case_store(spark, d):
    """Case store of error events, kept by a stream."""
    e = _stream(spark, d, "events").where("event_type = 'error'")
    key = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" :: "), F.col("props"))
    return _run_store(spark, stores.case_store(e, key, F.col("ts"), F.col("value"))).select("signature", "times_seen", F.unix_seconds(F.to_timestamp(F.concat(F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))).alias("last_seen"))


@query(f"SELECT {_KEY} AS signature, count(*) AS times_passed FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_pass_counter(spark, d):
    """Passes of view events, counted by a stream."""
    e = _stream(spark, d, "events").where("event_type = 'view'")
    key = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" :: "), F.col("props"))
    return _run_store(spark, stores.pass_counter(e, key, F.col("ts"))).select("signature", "times_passed")


_LADDER = """WITH e AS (SELECT user_id AS key, event_type <> 'error' AS ok, props AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), g AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM e),
    s AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY key, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS streak, list(CASE WHEN NOT ok THEN sig END) OVER (PARTITION BY key, g ORDER BY seq ROWS 4 PRECEDING) AS l FROM g), k AS (SELECT *, len(list_distinct(list_filter(l, lambda x: x IS NOT NULL))) AS kinds FROM s),
    u AS (SELECT *, CASE WHEN streak >= 6 THEN 4 WHEN streak >= 4 AND kinds >= 2 THEN 3 WHEN streak >= 3 THEN 2 WHEN streak >= 1 THEN 1 ELSE 0 END AS step FROM k)
    SELECT key, seq, streak::INT AS streak, ['continue', 'retry', 'rediagnose', 'replan', 'stop'][1 + max(step) OVER (PARTITION BY key, g ORDER BY seq ROWS UNBOUNDED PRECEDING)] AS strategy FROM u"""


@query(_LADDER)
def stream_failure_ladder(spark, d):
    """Streak and strategy after every event of each user, kept as state of a stream."""
    e = _t(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    base = scratch(spark)
    stores.numbered_events(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "seq", "ok", "props").write.parquet(f"{base}/events")
    stream = spark.readStream.schema("user_id bigint, seq bigint, ok boolean, props string").parquet(f"{base}/events")
    out = stores.failure_ladder(stream, "user_id", "seq", "ok", "props")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key bigint, seq bigint, streak int, strategy string").parquet(f"{base}/out")


@query(_LADDER)
def failure_ladder(spark, d):
    """Streak and strategy after every event of each user."""
    e = _t(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    numbered = stores.numbered_events(e, "user_id", [F.col("ts"), F.col("event_id")])
    return stores.failure_ladder_batch(numbered, "user_id", "seq", "ok", "props").withColumn("seq", F.col("seq").cast("bigint"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark, d):
    """Events numbered in each user's stream."""
    e = stores.numbered_events(_t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    return e.select("event_id", "user_id", F.col("seq").cast("bigint").alias("seq"))
