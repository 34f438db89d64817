"""Compositions: retrieval, failure advice, curation and corpus building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import aggregates as A
from casewright.operators import relational as R
from casewright.operators import sequences as S


def retrieve(cases: DataFrame, docs: DataFrame, question: str, n: int = 10) -> DataFrame:
    """Best cases and documents for a question: ``source``, ``key``, ``score``, ``rank``; ``n`` of each (a report).

    Cases match any word and go by sightings, documents by the share of words they hold. Words are those of at least
    three characters, the first twelve.
    """
    words = list(dict.fromkeys(w for w in question.lower().split() if len(w) >= 3))[:12] or [question.lower()]
    hit = R.keyword_any(cases, ["signature", "diagnosis"], words)
    a = hit.select(F.lit("case").alias("source"), F.col("id").cast("string").alias("key"), F.col("times_seen").cast("double").alias("score"), F.col("id").alias("_o"))
    b = R.keyword_density(docs, ["text", "heading"], words).select(F.lit("document").alias("source"), F.col("doc_id").cast("string").alias("key"), F.col("score").cast("double").alias("score"), F.col("doc_id").alias("_o"))
    return R.top_per(a.union(b), ["source"], [F.desc("score"), F.asc("_o")], n).drop("_o")


def advise(failures: DataFrame, key: str, text: str, cases: DataFrame) -> DataFrame:
    """Known diagnosis of each failure text: the case with its canonical signature, else the case whose error line is the same.

    Columns ``key``, ``tier`` (signature, error, none), ``case_id``, ``diagnosis``. Both tiers are equi joins against one
    case a key (the most seen); a failure without text gets ``none``.
    """
    f = failures.select(F.col(key).alias("_k"), X.first_line(F.col(text)).alias("_l"))
    f = f.withColumn("_s", X.canonical_signature("_l")).withColumn("_e", X.fold(X.baseline_paths(X.collapse(F.col("_l")))))
    rank = F.struct("times_seen", -F.col("id"))
    best = lambda k: cases.groupBy(k).agg(F.max_by(F.struct("id", "diagnosis"), rank).alias("_c"))
    exact = best(F.col("signature").alias("_s")).withColumnRenamed("_c", "_a")
    error = best(F.substring_index("signature", X.SEPARATOR, -1).alias("_e")).where("_e <> ''").withColumnRenamed("_c", "_b")
    both = f.join(exact, "_s", "left").join(error, "_e", "left")
    tier = F.when(F.col("_a").isNotNull(), "signature").when(F.col("_b").isNotNull(), "error").otherwise("none")
    c = F.coalesce("_a", "_b")
    return both.select(F.col("_k").alias(key), tier.alias("tier"), c["id"].alias("case_id"), c["diagnosis"].alias("diagnosis"))


#: How the goal of a session begins that nobody stated, and the dimensions of quality in order.
PLACEHOLDER = "continued prior work"
DIMENSIONS = ["verification", "recovery", "tool_use", "efficiency", "clarity", "completeness", "correctness", "robustness", "diversity", "relevance"]


def scan_text() -> Column:
    """All that an experience says, as one text."""
    parts = [F.col("goal"), F.array_join("actions", " "), *(F.col(c) for c in ("failure", "diagnosis", "resolution", "context"))]
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def with_penalties(e: DataFrame, pairs: Column | None = None) -> DataFrame:
    """``e`` with ``penalties``, what takes from the quality of an experience: ``dimension``, ``reason``, in order. ``pairs`` is the number
    of failures with their fix that its context holds (none if it isn't given). What is read more than once is a column: ``_words`` of
    the goal in lower case, ``_run``, ``_tools``, ``_empty``, ``_pairs``."""
    actions = F.coalesce("actions", F.array().cast("array<string>"))
    tools = F.coalesce(F.get_json_object("context", "$.tool_count").try_cast("bigint"), F.size(actions).cast("bigint"))
    words = F.filter(F.split(F.lower(F.coalesce("goal", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    empty = F.coalesce("goal", F.lit("")).startswith(PLACEHOLDER)
    read = e.withColumns({"_words": words, "_run": S.longest_run_in(actions), "_tools": tools, "_empty": empty, "_pairs": pairs if pairs is not None else F.lit(0)})
    silent = ~X.present(F.col("failure")) & ~X.present(F.col("resolution")) & (F.col("_pairs") == 0)
    one = lambda test, dimension, reason: F.when(test, F.struct(F.lit(dimension).alias("dimension"), reason.alias("reason")))
    each = F.array(
        one(F.col("_run") > 3, "efficiency", F.concat(F.lit("same action repeated "), F.col("_run").cast("string"), F.lit("x consecutively"))),
        one(F.col("_tools") > 30, "efficiency", F.concat(F.lit("tool_count "), F.col("_tools").cast("string"), F.lit(" exceeds 30"))),
        one((F.col("_tools") > 15) & silent, "efficiency", F.lit("large tool usage captured no failure/fix signal")),
        one(F.col("_empty"), "clarity", F.lit("placeholder goal")),
        one(~F.col("_empty") & (F.size("_words") < 3), "clarity", F.lit("goal under 3 words")),
    )
    return read.withColumn("penalties", F.filter(each, lambda x: x.isNotNull()))


def with_quality(e: DataFrame, pairs: Column | None = None) -> DataFrame:
    """``e`` with ``score`` (mean of the known quality dimensions), ``unknown`` (names of the others), ``flags`` and ``penalties``; diversity is
    known of no single experience."""
    read = with_penalties(e.withColumn("flags", X.flags(scan_text())), pairs)
    ok = F.coalesce("verification.ok", F.lit(False)) | F.coalesce(F.exists("verification.attempts", lambda a: F.coalesce(a["ok"], F.lit(False))), F.lit(False))
    has = lambda c: X.present(F.col(c))
    empty, worked = F.col("_empty"), F.coalesce(F.size("actions") > 0, F.lit(False))
    docked = lambda dimension: F.size(F.filter("penalties", lambda p: p["dimension"] == dimension))
    counted = F.coalesce(*(F.get_json_object("context", f"$.{k}") for k in ("message_count", "part_count", "tool_count"))).isNotNull()
    unsafe = F.size(F.array_intersect("flags", F.array(*(F.lit(n) for n, _ in X.DESTRUCTIVE)))) > 0
    substance = F.size(F.filter("_words", lambda w: ~w.isin(X.STOPWORDS)))
    known = {
        "verification": F.when(F.col("outcome") == "failed", 0.0).when(ok, 1.0),
        "recovery": F.when(has("failure") & (has("resolution") | has("diagnosis")), 1.0).when(has("failure"), 0.25),
        "tool_use": F.when(worked, F.least(F.lit(1.0), F.size(F.array_distinct("actions")) / 4.0)).otherwise(0.0),
        "efficiency": F.greatest(F.lit(0.0), 1.0 - 0.2 * docked("efficiency")),
        "clarity": F.when(empty, 0.25).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.3 * docked("clarity"))),
        "completeness": F.when(F.coalesce("goal", F.lit("")) == "", 0.0).when(empty, 0.2).otherwise(0.4) + F.when(worked, 0.3).otherwise(0.0) + F.when(counted, 0.3).otherwise(0.0),
        "correctness": F.when(unsafe, F.lit(None)).when(F.col("outcome") == "success", F.when(worked, 1.0).otherwise(0.0)).when(F.col("outcome") == "failed", 0.0),
        "robustness": F.when(F.col("_pairs") > 0, F.least(F.lit(1.0), F.col("_pairs") / 3.0)).when(has("failure"), 0.5),
        "diversity": F.lit(None).cast("double"),
        "relevance": F.when(empty, 0.25).otherwise(F.least(F.lit(1.0), substance / 5.0)),
    }
    rated = read.withColumn("_dims", F.array(*(known[d] for d in DIMENSIONS)))
    kept = F.filter("_dims", lambda x: x.isNotNull())
    rated = rated.withColumn("_known", kept)
    mean = F.when(F.size("_known") > 0, F.round(F.reduce("_known", F.lit(0.0), lambda a, x: a + x) / F.size("_known"), 4)).otherwise(0.0)
    names = F.filter(F.array(*map(F.lit, DIMENSIONS)), lambda n, k: F.get("_dims", k).isNull())
    return rated.withColumns({"score": mean, "unknown": names}).drop("_words", "_run", "_tools", "_empty", "_pairs", "_dims", "_known")


def curate(experiences: DataFrame) -> DataFrame:
    """Scored experiences, one for each normalised goal: score, flags, diversity, sightings and the number absorbed.

    Redelivered rows count once. The winner of a goal is the row with the best score, the smallest id among equals.
    """
    e = with_quality(experiences.dropDuplicates(["experience_id"]))
    scored = e.select("experience_id", "goal", "times_seen", F.get_json_object("context", "$.source").alias("source"), "project_type", "score", "unknown", "flags")
    scored = A.rarity(scored, ["source", "project_type"])
    row = F.struct("experience_id", "score", "diversity", "flags", "unknown")
    won = scored.groupBy(X.normal_goal(F.coalesce("goal", F.lit(""))).alias("goal_key")).agg(
        F.min_by(row, F.struct(-F.col("score"), F.col("experience_id"))).alias("w"), F.sum("times_seen").alias("times_seen"), (F.count("*") - 1).alias("absorbed")
    )
    return won.select("goal_key", "w.*", "times_seen", "absorbed")


def lessons(experiences: DataFrame) -> DataFrame:
    """What unflagged experiences teach: a failure with its diagnosis, or a procedure of at least three actions with its tools."""
    e = experiences.dropDuplicates(["experience_id"])
    clean = e.where(F.size(X.flags(scan_text())) == 0)
    failure = clean.where(X.present(F.col("failure")) & X.present(F.col("diagnosis"))).select("experience_id", F.lit("failure").alias("kind"), F.substring("failure", 1, 200).alias("lesson"))
    tools = F.array_join(F.array_sort(F.array_distinct("actions")), ",")
    skill = clean.where((F.col("outcome") == "success") & (F.size("actions") >= 3)).select("experience_id", F.lit("procedure").alias("kind"), tools.alias("lesson"))
    return failure.union(skill)


def training_corpus(trajectories: DataFrame, deliberate: Column, budget_ratio: int = 2) -> DataFrame:
    """Deliberate trajectories and a fair draw of the others, at most ``budget_ratio`` times as many: ``traj_id``, ``lane``.

    The draw takes one of each goal a round. The budget is one number; with no deliberate row nothing is drawn out,
    for the cap has no base then.
    """
    t = trajectories.dropDuplicates(["traj_id"]).withColumn("_d", F.coalesce(deliberate, F.lit(False))).withColumn("_g", X.normal_goal(F.coalesce("goal", F.lit(""))))
    base = t.where("_d").select("traj_id", F.lit("deliberate").alias("lane"))
    count = base.count()
    real = t.where("NOT _d").select("traj_id", "_g", "session_id")
    kept = S.round_robin(real, "_g", [F.asc_nulls_first("session_id"), F.asc("traj_id")], budget_ratio * count, F.col("traj_id")) if count else real
    return base.union(kept.select("traj_id", F.lit("real").alias("lane")))


def chat_records(trajectories: DataFrame) -> DataFrame:
    """Trajectories as chats: the goal as user, each step as assistant call and user result, the final answer as assistant."""
    t = trajectories.dropDuplicates(["traj_id"])
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    call = lambda s: F.concat(F.lit("[TOOL: "), s["tool"], F.lit("("), F.coalesce(s["args"], F.lit("{}")), F.lit(")]"))
    turns = F.flatten(F.transform(F.coalesce("steps", F.expr("array()").cast(t.schema["steps"].dataType)), lambda s: F.array(message("assistant", call(s)), message("user", F.coalesce(s["result_head"], F.lit(""))))))
    last = F.when(X.present(F.col("final_answer")), F.array(message("assistant", F.col("final_answer")))).otherwise(F.slice(F.array(message("assistant", F.lit(""))), 1, 0))
    return t.select("traj_id", F.concat(F.array(message("user", F.coalesce("goal", F.lit("")))), turns, last).alias("messages"), F.size("steps").alias("steps"))


def assistant_ratio(chats: DataFrame) -> DataFrame:
    """Share of the words that assistants say in all chats: one row."""
    m = chats.select(F.explode("messages").alias("m")).select(F.col("m.role").alias("role"), F.size(F.filter(F.split("m.content", r"\s+"), lambda w: w != "")).alias("n"))
    return m.agg(F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("assistant"), F.sum("n").alias("words")).withColumn("ratio", F.round(F.col("assistant") / F.nullif("words", F.lit(0)), 4))
