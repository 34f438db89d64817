"""Checks, gates and renderings of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import is_continuation, is_greeting, normal_goal, present, version_tuple


def relevant_sentences(text: Column, terms: list[str], longest: int = 400, first: int = 10) -> Column:
    """First sentences and lines of a text that hold any of the terms, each cut to ``longest`` characters (a report)."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    hit = F.filter(parts, lambda s: F.reduce(F.array(*(F.contains(F.lower(s), F.lit(t.lower())) for t in terms)), F.lit(False), lambda a, x: a | x))
    return F.slice(F.transform(hit, lambda s: F.substring(F.trim(s), 1, longest)), 1, first)


def facts_missing(answer: Column, facts: Column) -> Column:
    """Facts of an array that the answer doesn't hold, whatever the case; all of them for a null answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(facts, lambda f: ~F.contains(low, F.lower(f)))


def verified_steps(steps: DataFrame, key: str, pos: str) -> DataFrame:
    """Outcome ``ok`` of every verification step; after the first failure that isn't optional the rest is null (skipped).

    Read: ``exit_code``, ``want_exit``, ``output``, ``must_contain``, ``must_not_contain``, ``optional``; a null condition holds.
    """
    out = F.coalesce("output", F.lit(""))
    good = (
        (F.col("want_exit").isNull() | F.col("exit_code").eqNullSafe(F.col("want_exit")))
        & (F.col("must_contain").isNull() | F.contains(out, F.col("must_contain")))
        & (F.col("must_not_contain").isNull() | ~F.contains(out, F.col("must_not_contain")))
    )
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    marked = steps.withColumn("_good", good).withColumn("_stop", F.coalesce(F.bool_or(~F.col("_good") & ~F.coalesce("optional", F.lit(False))).over(before), F.lit(False)))
    return marked.withColumn("ok", F.when(~F.col("_stop"), F.col("_good"))).drop("_good", "_stop")


def requirements(required: DataFrame, found: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Status of every requirement: ok, missing, or mismatch where the found version is lower or can't be read."""
    r = required.select(name, F.col(version).alias("required"))
    f = found.groupBy(name).agg(F.max_by(F.col(version), version_tuple(F.col(version))).alias("found"))
    a, b = version_tuple(F.col("required")), version_tuple(F.col("found"))
    size = F.greatest(F.size(a), F.size(b))
    pad = lambda v: F.transform(F.sequence(F.lit(1), size), lambda k: F.coalesce(F.try_element_at(v, k), F.lit(0)))
    status = F.when(F.col("_there").isNull(), "missing").when(b.isNull() | (a.isNotNull() & (pad(b) < pad(a))), "mismatch").otherwise("ok")
    return r.join(f.withColumn("_there", F.lit(True)), name, "left").select(name, "required", "found", status.alias("status"))


def url_allowed(url: Column) -> Column:
    """Whether an address may be fetched as far as its text tells: http or https, port 80 or 443, a host that is no private address."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    port = F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*?:(\d+)(?:[/?#]|$)", 1), F.lit(""))
    private = host.rlike(r"^(?:localhost|.*\.local|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|\[)")
    return F.coalesce(url.rlike(r"(?i)^https?://") & host.isNotNull() & (port.isNull() | port.isin("80", "443")) & ~private, F.lit(False))


def is_hash_query(text: Column) -> Column:
    """Whether a query is a commit or content hash: at least seven hex digits and nothing else."""
    return F.coalesce(F.trim(text).rlike(r"^[0-9a-fA-F]{7,64}$"), F.lit(False))


def duplicate_split(incoming: DataFrame, live: DataFrame, key: str, line: str) -> DataFrame:
    """Offending lines of an import: repeated inside the file (but for the first), or already live."""
    first = incoming.groupBy(key).agg(F.min(line).alias("_first"))
    known = live.select(key).distinct().withColumn("_live", F.lit(True))
    rows = incoming.join(first, key).join(known, key, "left")
    kind = F.when(F.col(line) > F.col("_first"), "in file").when(F.col("_live"), "live")
    return rows.select(line, key, kind.alias("kind")).where("kind IS NOT NULL")


def hygiene(records: DataFrame, goal: str, id_col: str) -> DataFrame:
    """Records that a cleanup removes, with the rule: greeting or continuation."""
    g = F.col(goal)
    rule = F.when(is_continuation(g), "continuation").when(is_greeting(g), "greeting")
    return records.select(id_col, rule.alias("rule")).where("rule IS NOT NULL")


def render_demonstration(goal: Column, steps: Column, first: int = 6, width: int = 160) -> Column:
    """A demonstration as text: the goal and its first steps, numbered, with the head of each result."""
    one = lambda s, k: F.concat((k + 1).cast("string"), F.lit(". "), s["tool"], F.lit(" "), F.coalesce(s["args"], F.lit("{}")), F.lit(" -> "), F.substring(F.coalesce(s["result_head"], F.lit("")), 1, width))
    return F.concat(F.lit("Goal: "), goal, F.lit("\n"), F.array_join(F.transform(F.slice(steps, 1, first), one), "\n"))


def protocol_metrics(runs: DataFrame, steps: str) -> DataFrame:
    """How runs use their tools, one row: mean steps, failed share, runs that begin with a listing, runs that read before they write."""
    s = F.col(steps)
    write = lambda x: x["tool"].isin("write_file", "edit_file", "apply_patch")
    first_write = F.array_position(F.transform(s, write), F.lit(True))
    first_read = F.array_position(F.transform(s, lambda x: x["tool"] == "read_file"), F.lit(True))
    some = runs.where(F.size(s) > 0)
    return some.agg(
        F.count("*").alias("runs"),
        F.round(F.avg(F.size(s)), 4).alias("mean_steps"),
        F.round(F.sum(F.size(F.filter(s, lambda x: ~F.coalesce(x["ok"], F.lit(True))))) / F.sum(F.size(s)), 4).alias("failed_share"),
        F.count_if(s[0]["tool"] == "list_directory").alias("list_first"),
        F.count_if((first_write > 0) & (first_read > 0) & (first_read < first_write)).alias("read_before_write"),
    )


def first_failure(observations: DataFrame, key: str, order: list[Column], text: str, width: int = 300) -> DataFrame:
    """First line of the first observation of each key that has failure text."""
    o = observations.where(present(F.col(text)))
    got = o.groupBy(key).agg(F.min_by(text, F.struct(*order)).alias("_t"))
    return got.select(key, F.substring(F.regexp_extract("_t", r"^\s*([^\r\n]*)", 1), 1, width).alias("failure"))


def covered_goals(wanted: DataFrame, goal: str, done: DataFrame, done_goal: str, ok: Column) -> DataFrame:
    """Wanted goals without a successful record of the same normalised goal."""
    have = done.where(ok).select(normal_goal(F.col(done_goal)).alias("_g")).distinct()
    return wanted.withColumn("_g", normal_goal(F.col(goal))).join(have, "_g", "left_anti").drop("_g")


def glob_rules(tool: str, args: str, rules: list[tuple[str, str, str]], default: str) -> Column:
    """Decision of the first rule ``(tool glob, text in the arguments or '', decision)`` that fits a call."""
    out = None
    for glob, needle, decision in rules:
        form = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob) + "$"
        fits = F.col(tool).rlike(form) & (F.contains(F.lower(F.coalesce(args, F.lit(""))), F.lit(needle.lower())) if needle else F.lit(True))
        out = F.when(fits, decision) if out is None else out.when(fits, decision)
    return F.lit(default) if out is None else out.otherwise(default)
