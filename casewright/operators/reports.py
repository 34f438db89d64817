"""Decisions on failures and permissions, imports, comparisons of runs, checks of demonstrations, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import parse_stamp, strip
from casewright.operators.records import all_reasons, first_decision, substantive

# What errors of the environment say.
ENVIRONMENT_MARKERS = ["no module named", "not recognized", "is not recognized", "file not found", "command not found", "no such file", "connection refused", "address already in use", "permission denied", "access is denied"]


def says_any(text: Column, markers: list[str]) -> Column:
    """Whether a text holds any of the markers, whatever the case; null texts hold none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def recovery(kind: Column, text: Column, repeats: Column, alternates: Column, escalation: Column, left: Column, environment: Column, cycling: Column, same: int = 3, most: int = 2) -> tuple[Column, Column]:
    """(strategy, reason) for a failure: what ends the attempt first, then the same failure again and again, the environment (twice at
    most), failures that cycle, and a failed verification; else a retry with advice. After ``most`` alternates it is escalation, or a person."""
    stuck, turning = repeats >= same, cycling
    env = says_any(text, ENVIRONMENT_MARKERS) & (environment < 2)
    return first_decision(
        [
            (~left, "terminate", "no iterations left"),
            (stuck & (alternates < most), "alternate_approach", "same failure"),
            (stuck & escalation, "escalate_model", "same failure after alternates"),
            (stuck, "ask_user", "same failure after alternates"),
            (env, "environment_check", "environment"),
            (turning & (alternates < most), "alternate_approach", "cycling"),
            (turning & escalation, "escalate_model", "cycling after alternates"),
            (turning, "ask_user", "cycling after alternates"),
            (kind == "verification", "alternate_approach", "verification failed"),
        ],
        ("retry_with_advice", "first occurrence"),
    )


def permission(rule: Column, confirm: Column, level: Column, defaults: dict[str, str], fallback: str) -> tuple[Column, Column]:
    """(mode, tier) of a call: the explicit rule's mode (null where none fits), asking where the tool wants to be confirmed, the default of
    its level of effects, the fallback."""
    table = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    of_level = F.try_element_at(table, level)
    tier = F.when(rule.isNotNull(), "rule").when(F.coalesce(confirm, F.lit(False)), "confirmation").when(of_level.isNotNull(), "level").otherwise("fallback")
    return F.when(tier == "rule", rule).when(tier == "confirmation", F.lit("ask")).when(tier == "level", of_level).otherwise(F.lit(fallback)), tier


def replaced(live: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(store, offenders) of an import that replaces the store: keys that come twice, or are live already, stop it (``reason``); then the
    store stays. The decision is one row that both sides are joined with."""
    twice = incoming.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit("in file").alias("reason"))
    both = incoming.select(key).distinct().join(live.select(key).distinct(), key, "left_semi").select(key, F.lit("live").alias("reason"))
    offenders = twice.union(both.join(twice.select(key), key, "left_anti"))
    stop = offenders.agg((F.count("*") > 0).alias("_stop"))  # one row
    columns = [c for c in live.columns]
    old = live.crossJoin(F.broadcast(stop)).where("_stop").select(*columns)
    return old.union(incoming.select(*columns).crossJoin(F.broadcast(stop)).where("NOT _stop").select(*columns)), offenders


def run_deltas(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Changes of success rate and mean iterations between two runs, of the models that both have."""
    rate = lambda d, x: d.groupBy(*by).agg(F.round(F.count_if("success") / F.count("*"), 3).alias(f"_r{x}"), F.round(F.avg("iterations"), 1).alias(f"_i{x}"))
    both = rate(before, "a").join(rate(after, "b"), by)
    return both.select(*by, F.round(F.col("_rb") - F.col("_ra"), 3).alias("success_rate"), F.round(F.col("_ib") - F.col("_ia"), 1).alias("avg_iterations"))


def rule_matches_with_exit(texts: DataFrame, key: str, text: str, code: str, rules: list[tuple[str, str, int | None]]) -> DataFrame:
    """Every rule ``(id, pattern, exit code or None)`` that fits a text and its exit code, and whether several do."""
    fits = [F.when(F.col(text).rlike(p) & (F.lit(True) if c is None else F.coalesce(F.col(code) == c, F.lit(False))), F.lit(i)) for i, p, c in rules]
    rows = texts.select(key, F.filter(F.array(*fits), lambda x: x.isNotNull()).alias("_h")).where(F.size("_h") > 0)
    return rows.select(key, F.explode("_h").alias("rule"), (F.size("_h") > 1).alias("ambiguous"))


def demonstration_faults(goal: Column, steps: Column, final: Column, discover: list[str], read: list[str], write: list[str]) -> Column:
    """What keeps a demonstration from being taught, in order: it doesn't begin with a look around, never reads, writes what it hasn't read,
    has no final answer, names no file that it touched, or has a goal of under three words."""
    first = F.try_element_at(steps, F.lit(1))["tool"]
    path = lambda s: F.coalesce(F.get_json_object(s["args"], "$.path"), F.lit(""))
    marked = F.transform(steps, lambda s, k: F.struct(k.alias("k"), s["tool"].alias("tool"), path(s).alias("path")))
    reads, writes = F.filter(marked, lambda s: s["tool"].isin(read)), F.filter(marked, lambda s: s["tool"].isin(write))
    blind = F.exists(writes, lambda w: ~F.exists(reads, lambda r: (r["path"] == w["path"]) & (r["k"] < w["k"])))
    named = F.exists(marked, lambda s: (s["path"] != "") & F.contains(F.coalesce(final, F.lit("")), s["path"]))
    return all_reasons(
        [
            (~F.coalesce(first.isin(discover), F.lit(False)), "no look around first"),
            (F.size(reads) == 0, "reads nothing"),
            (blind, "writes what it has not read"),
            (F.length(strip(F.coalesce(final, F.lit("")))) == 0, "no final answer"),
            (~named, "final answer names no file"),
            (~substantive(goal, 3), "goal under three words"),
        ]
    )


def case_report(cases: DataFrame, now: Column, top: int = 5, days: int = 30) -> DataFrame:
    """Lines of a report on the case base: ``part`` (total, top, stale), ``rank``, ``line``. The top is the few most seen; stale ones are all."""
    total = cases.agg(F.lit("total").alias("part"), F.lit(0).cast("bigint").alias("rank"), F.concat(F.lit("total cases: "), F.count("*").cast("string")).alias("line"))
    line = lambda what: F.concat(F.lit("case #"), F.col("id").cast("string"), F.lit(f" {what}="), F.col(what).cast("string"), F.lit(" sig: "), F.col("signature"))
    first = cases.orderBy(F.desc("times_seen"), "id").limit(top)
    seen = first.select(F.lit("top").alias("part"), F.col("id").alias("rank"), line("times_seen").alias("line"))
    old = cases.where(parse_stamp(F.col("last_seen")) < now - F.expr(f"INTERVAL {int(days)} DAYS")).select(F.lit("stale").alias("part"), F.col("id").alias("rank"), line("last_seen").alias("line"))
    return total.union(seen).union(old)


def captured(observations: DataFrame, key: Column, ok: Column, at: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """(cases, passes) of observations, batch or stream: failures are counted with their last text, passes with their last time."""
    seen = observations.select(key.alias("signature"), ok.alias("_ok"), at.alias("at"), value.alias("value"))
    failures = seen.where(~F.col("_ok")).groupBy("signature").agg(F.count("*").alias("times_seen"), F.max("at").alias("last_seen"), F.max_by("value", F.struct("at", "value")).alias("value"))
    passes = seen.where("_ok").groupBy("signature").agg(F.count("*").alias("times_passed"), F.max("at").alias("last_pass"))
    return failures, passes
