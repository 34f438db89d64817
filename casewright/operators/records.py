"""Records of trajectories: decisions with reasons, projections, chats, lanes.

Thresholds, class maps and word lists are parameters; what is here is how they are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.calls import render_call
from casewright.functions.text import canonical_signature, normal_goal, present, strip
from casewright.operators.sequences import prefix_before_in

MESSAGES = "array<struct<role: string, content: string>>"


def first_decision(rules: list[tuple[Column, str, str]], default: tuple[str, str]) -> tuple[Column, Column]:
    """(value, reason) of the first rule ``(condition, value, reason)`` that holds; a null condition doesn't."""
    value, reason = F.lit(default[0]), F.lit(default[1])
    for condition, v, r in reversed(rules):
        holds = F.coalesce(condition, F.lit(False))
        value, reason = F.when(holds, F.lit(v)).otherwise(value), F.when(holds, F.lit(r)).otherwise(reason)
    return value, reason


def all_reasons(rules: list[tuple[Column, Column | str]]) -> Column:
    """Reasons of all rules ``(condition, reason)`` that hold, in order."""
    each = [F.when(F.coalesce(c, F.lit(False)), F.lit(r) if isinstance(r, str) else r) for c, r in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def mapped(value: Column, names: dict[str, str], default: str) -> Column:
    """A value's name in a fixed map, or the default."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def session_outcome(state: Column, attempts: Column) -> Column:
    """Outcome of a session by its state and verification attempts: a completed one is a success if its first attempt passed,
    recovered if any was made, partial without; a failed one failed; all others are partial."""
    first = F.coalesce(F.try_element_at(attempts, F.lit(1))["ok"], F.lit(False))
    done = F.when(first, "success").when(F.size(attempts) > 0, "recovered").otherwise("partial")
    return F.when(state == "completed", done).when(state == "failed", F.lit("failed")).otherwise(F.lit("partial"))


def project_tag(tags: Column) -> Column:
    """The second tag, else the first, else ``unknown``."""
    return F.coalesce(F.try_element_at(tags, F.lit(2)), F.try_element_at(tags, F.lit(1)), F.lit("unknown"))


def failed_steps(steps: Column) -> Column:
    """Steps that went wrong; those without a result don't count."""
    return F.size(F.filter(steps, lambda s: s["ok"] == F.lit(False)))


def has_evidence(ok: Column, attempts: Column) -> Column:
    """Whether a verification passed, as a whole or in any attempt."""
    return F.coalesce(ok, F.lit(False)) | F.coalesce(F.exists(attempts, lambda a: F.coalesce(a["ok"], F.lit(False))), F.lit(False))


def trainable(steps: Column) -> Column:
    """Whether there are steps and all have an object of arguments."""
    return F.coalesce((F.size(steps) > 0) & F.forall(steps, lambda s: F.coalesce(s["args"].startswith("{"), F.lit(False))), F.lit(False))


def tagged_any(tags: Column, names: list[str]) -> Column:
    """Whether tags and names have an element in common."""
    return F.coalesce(F.size(F.array_intersect(tags, F.array(*map(F.lit, names)))) > 0, F.lit(False))


def superseded(tags: Column, steps: Column, lane: str, version: str, mark: str, exempt: list[str], opener: str = "read_file") -> Column:
    """Tags with ``mark`` added where a record of a lane is out of date: it lacks the version tag, or opens with the reading tool
    and isn't exempt. Records of other lanes, and those already marked, keep their tags."""
    opens = F.coalesce(F.try_element_at(steps, F.lit(1))["tool"] == opener, F.lit(False))
    old = ~F.array_contains(tags, version) | (opens & ~tagged_any(tags, exempt))
    hit = F.array_contains(tags, lane) & ~F.array_contains(tags, mark) & old
    return F.when(hit, F.array_append(tags, mark)).otherwise(tags)


def opening_guess(tags: Column, steps: Column, lane: str, mark: str, tool: str = "read_file") -> Column:
    """Whether the first use of a tool in a record of a lane that isn't marked yet went wrong."""
    first = F.try_element_at(F.filter(steps, lambda s: s["tool"] == tool), F.lit(1))
    return F.array_contains(tags, lane) & ~F.array_contains(tags, mark) & F.coalesce(first["ok"] == F.lit(False), F.lit(False))


def with_after_steps(failures: Column, attempts: Column, most: int = 3) -> Column:
    """The first failures (``detail``, ``after_step``), each with the step of the failed attempt in the same place where it has none."""
    few = F.slice(failures, 1, most)
    failed = F.filter(attempts, lambda a: ~F.coalesce(a["ok"], F.lit(False)))
    own = lambda f, k: F.struct(f["detail"].alias("detail"), F.coalesce(f["after_step"], F.try_element_at(failed, k + 1)["after_step"]).alias("after_step"))
    return F.transform(few, own)


def procedure(actions: Column, calls: Column) -> Column:
    """Actions as call texts: the k-th with the arguments of the k-th captured call if that has its name, else bare."""

    def one(action: Column, k: Column) -> Column:
        call = F.try_element_at(calls, k + 1)
        same = F.coalesce(call["tool"] == action, F.lit(False))
        return render_call(action, F.from_json(F.when(same, call["args"]).otherwise(F.lit("{}")), "map<string,string>"))

    return F.transform(actions, one)


def kept_steps(steps: Column, deliberate: Column) -> Column:
    """Steps that a chat teaches, with their place ``k`` (from 1) in the whole: all of a deliberate record, else those that didn't fail."""
    numbered = F.transform(steps, lambda s, k: F.struct((k + 1).alias("k"), s["tool"].alias("tool"), s["args"].alias("args"), s["ok"].alias("ok"), s["result_head"].alias("result_head")))
    return F.filter(numbered, lambda s: deliberate | F.coalesce(s["ok"], F.lit(True)))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _step_messages(s: Column, width: int) -> Column:
    seen = F.coalesce(F.nullif(s["result_head"], F.lit("")), F.when(s["ok"], F.lit("ok")).otherwise(F.lit("no output captured")))
    return F.array(_message("assistant", render_call(s["tool"], F.from_json(s["args"], "map<string,string>"))), _message("user", F.substring(seen, 1, width)))


def plain_goal(goal: Column) -> Column:
    """A goal without the note of the run that it came from."""
    return F.regexp_replace(F.coalesce(goal, F.lit("")), r"\s*\(benchmark run [0-9a-f]{8}\)$", "")


def chat(system: str, goal: Column, steps: Column, failures: Column, final: Column, deliberate: Column, width: int = 2000) -> Column:
    """Messages that teach a record: system, goal, each kept step as call and observation, the final answer.

    A failure with ``after_step`` (in the full list) puts its detail after the kept steps up to there; places only rise, so one that
    isn't beyond the last is left out, as is one beyond the end. Null or empty final answers name the goal as completed.
    """
    kept = kept_steps(steps, deliberate)
    place = lambda f: F.when((f["after_step"] > 0) & (f["after_step"] <= F.size(steps)), F.size(F.filter(kept, lambda s: s["k"] <= f["after_step"])))
    spots = F.transform(failures, lambda f: F.struct(place(f).alias("at"), f["detail"].alias("detail")))
    none = F.array().cast("array<struct<at: int, detail: string>>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["at"], F.lit(0))
    rising = F.reduce(spots, none, lambda a, f: F.when(f["at"] > last(a), F.concat(a, F.array(f.cast("struct<at: int, detail: string>")))).otherwise(a))
    refused = lambda k: F.transform(F.filter(rising, lambda f: f["at"] == k + 1), lambda f: _message("user", F.substring(F.coalesce(f["detail"], F.lit("")), 1, width)))
    turns = F.flatten(F.transform(kept, lambda s, k: F.concat(_step_messages(s, width), refused(k))))
    end = F.coalesce(F.nullif(final, F.lit("")), F.concat(F.lit("Completed: "), F.substring(F.coalesce(goal, F.lit("")), 1, width)))
    return F.concat(F.array(_message("system", F.lit(system)), _message("user", plain_goal(goal))), turns, F.array(_message("assistant", end))).cast(MESSAGES)


WRITES, READS = ["edit_file", "write_file"], ["read_file"]


def prefix_lane(df: DataFrame, key: str, goal: str, steps: str, system: str, width: int = 2000) -> DataFrame:
    """Chats of what failed records found out before their first write: ``goal_key``, ``key``, ``length``, ``messages``.

    The steps that went well up to the last read before the first write, two at least; records without a write have none. Of each goal
    the longest is kept, the smallest key among equals (an aggregate, so a hot goal is combined before the shuffle).
    """
    whole = F.filter(F.col(steps), lambda s: F.coalesce(s["args"].startswith("{"), F.lit(False)))
    writes = F.exists(whole, lambda s: s["tool"].isin(WRITES))
    found = F.when(writes, prefix_before_in(whole, lambda s: s["tool"].isin(WRITES), lambda s: s["tool"].isin(READS), lambda s: s["ok"]))
    rows = df.select(F.lower(strip(plain_goal(F.col(goal)))).alias("goal_key"), key, goal, found.alias("_p")).where(F.size("_p") >= 2)
    best = rows.groupBy("goal_key").agg(F.min_by(F.struct(key, goal, "_p"), F.struct(-F.size("_p"), F.col(key))).alias("b")).select("goal_key", "b.*")
    turns = F.flatten(F.transform("_p", lambda s: _step_messages(s, width)))
    return best.select("goal_key", key, F.size("_p").alias("length"), F.concat(F.array(_message("system", F.lit(system)), _message("user", plain_goal(F.col(goal)))), turns).cast(MESSAGES).alias("messages"))


def pairs_of(source: str, instruction: str, shown: Column, output: Column, key: Column) -> list[Column]:
    """Columns of an instruction pair: ``source``, ``key``, ``instruction``, ``input``, ``output``."""
    return [F.lit(source).alias("source"), key.cast("string").alias("key"), F.lit(instruction).alias("instruction"), shown.alias("input"), output.alias("output")]


def command_key(command: Column) -> Column:
    """What signatures of failures of a command begin with."""
    return F.split(canonical_signature(F.concat(command, F.lit(" :: pass-probe"))), " :: ")[0]


def match_by_command(cases: DataFrame, passes: DataFrame, command: str) -> DataFrame:
    """Cases whose signature begins with the key of a command: an equality join on the part before the separator."""
    keyed = cases.withColumn("_c", F.split("signature", " :: ")[0])
    return keyed.join(passes.select(F.col(command), command_key(F.col(command)).alias("_c")).distinct(), "_c").drop("_c")


def candidate_signature(goal: Column, failure: Column) -> Column:
    """Signature of what a record could become as a case."""
    return canonical_signature(F.concat(F.substring(goal, 1, 60), F.lit(" :: "), F.substring(failure, 1, 200)))


def state_faults(rows: DataFrame, key: str, order: list[Column], state: str, final: list[str]) -> DataFrame:
    """Rows that follow a final state of their key, with that state: ``after``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(state).over(w)
    return rows.withColumn("after", before).where(F.col("after").isin(final))


def ring(rows: DataFrame, key: str, order: list[Column], keep: int, above: int | None = None) -> DataFrame:
    """The last ``keep`` rows of each key; with ``above``, only keys of more rows than that are cut."""
    from pyspark.sql import Window

    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if above is None:
        return last.where(F.col("_k") <= keep).drop("_k")
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return last.join(sizes, key).where((F.col("_n") <= above) | (F.col("_k") <= keep)).drop("_k", "_n")


def new_candidates(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct candidates whose keys aren't known yet; member lists count in the order they have."""
    return found.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti")


def line_order(docs: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """Whether the first line that has ``first`` stands before the first that has ``second``: PASS, FAIL, or SKIP without the latter."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n"), lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    at = lambda p: F.try_element_at(F.filter(lines, lambda s: s["x"].rlike(p)), F.lit(1))["k"]
    a, b = at(first), at(second)
    return docs.select(key, F.when(b.isNull(), "SKIP").when(a.isNull() | (a > b), "FAIL").otherwise("PASS").alias("status"))


def decided(candidates: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taught, rejected, open) candidates by a table of decisions (``key``, ``decision``): accept, reject, none."""
    both = candidates.join(decisions.select(key, "decision"), key, "left")
    return both.where("decision = 'accept'").drop("decision"), both.where("decision = 'reject'").drop("decision"), both.where("decision IS NULL").drop("decision")


def shown(df: DataFrame, order: list[Column], limit: int = 10) -> DataFrame:
    """The first rows of an order with ``more``, the number of those that aren't shown (a report)."""
    total = df.agg(F.count("*").alias("_n"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")  # one row


def goal_key(goal: Column) -> Column:
    """Goal of a draw: normalised, without the note of its run."""
    return normal_goal(plain_goal(goal))


def substantive(goal: Column, least: int = 3) -> Column:
    """Whether a goal has that many words."""
    return F.size(F.filter(F.split(F.coalesce(goal, F.lit("")), r"[^\p{L}\p{N}_]+"), lambda w: w != "")) >= least


def is_resume(goal: Column, phrases: list[str]) -> Column:
    """Whether a goal only takes up interrupted work: any of the phrases, whatever the case."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    return F.reduce(F.array(*(low.contains(p) for p in phrases)), F.lit(False), lambda a, x: a | x)


def with_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold something in all of the columns."""
    for c in columns:
        df = df.where(present(strip(F.col(c))))
    return df
