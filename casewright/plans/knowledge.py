"""Searches over all that is stored, reviews of what is pending, and generated goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import relational as R


def unified_search(cases: DataFrame, docs: DataFrame, experiences: DataFrame, question: str, n: int = 3) -> DataFrame:
    """Best ``n`` of each store for a question: ``source``, ``key``, ``score``, ``rank`` (a report). Cases go by sightings, documents by the share of
    the words that they hold, experiences by shared words, sightings and confidence."""
    words = list(dict.fromkeys(w for w in question.lower().split() if len(w) >= 3))[:12] or [question.lower()]
    row = lambda df, source, key, score: df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.col(score).cast("double").alias("score"))
    a = row(R.keyword_any(cases, ["signature", "diagnosis"], words), "case", "id", "times_seen")
    b = row(R.keyword_density(docs, ["text", "heading"], words), "document", "doc_id", "score")
    c = row(R.similar(experiences, "goal", question, "times_seen", "confidence"), "experience", "experience_id", "score")
    return R.top_per(a.union(b).union(c), ["source"], [F.desc("score"), F.asc("key")], n)


def reviewed(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases after a review: ``decisions`` has ``id``, ``action`` (confirm, correct), ``by``, ``diagnosis``. Cases somebody confirmed already, and
    those without a decision, stay as they are; a correction also confirms."""
    d = decisions.select("id", "action", "by", F.col("diagnosis").alias("_d"))
    both = cases.join(d, "id", "left")
    open_ = F.coalesce(F.col("confirmed_by") == "unknown", F.lit(True)) & F.col("action").isin("confirm", "correct")
    hit = F.coalesce(open_, F.lit(False))
    text = F.when(hit & (F.col("action") == "correct") & X.present(F.col("_d")), F.col("_d")).otherwise(F.col("diagnosis"))
    return both.withColumns({"diagnosis": text, "confirmed_by": F.when(hit, F.col("by")).otherwise(F.col("confirmed_by"))}).select(*cases.columns)


def changed_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks after changes (``id``, ``op`` done or delete, ``at``), one a task; a task that is done already keeps its stamp."""
    both = tasks.join(changes.select("id", "op", "at"), "id", "left").where("op IS NULL OR op <> 'delete'")
    done = F.coalesce((F.col("op") == "done") & (F.col("status") != "done"), F.lit(False))
    return both.withColumns({"done_at": F.when(done, F.col("at")).otherwise(F.col("done_at")), "status": F.when(done, F.lit("done")).otherwise(F.col("status"))}).select(*tasks.columns)


def generated_goals(spark: SparkSession, templates: list[str], slots: dict[str, list[str]], count: int, seed: int = 0) -> tuple[DataFrame, int]:
    """(goals, shortfall): up to ``count`` goals that differ when normalised, made of templates whose ``{slot}`` are filled by hashes of
    seed and number, so the same on every run and cluster. Four times as many are made as asked for; what is still missing is the shortfall."""
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    text = F.array(*map(F.lit, templates))[pick("template", len(templates))]
    for name, values in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.array(*map(F.lit, values))[pick(name, len(values))])
    made = spark.range(4 * count).select("id", text.alias("goal"))
    first = made.groupBy(X.normal_goal(F.col("goal")).alias("goal_key")).agg(F.min_by("goal", "id").alias("goal"), F.min("id").alias("id"))
    kept = first.orderBy("id").limit(count)
    return kept, max(0, count - kept.count())
