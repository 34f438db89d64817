"""Operators on ordered sequences.

Steps of one record live in an array column, so their operators are expressions inside the row (``*_in`` functions, no
shuffle); sequences across rows are windows over a key and a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.plans.session import cut, stored


def longest_run_in(items: Column) -> Column:
    """Longest run of equal neighbours of an array; 0 for an empty one, null elements end a run."""
    step = lambda acc, x: F.struct(
        F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
        F.greatest(acc["best"], F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))).alias("best"),
        x.alias("last"),
    )
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(None).cast("string").alias("last"))
    return F.coalesce(F.reduce(items, start, step, lambda a: a["best"]), F.lit(0))


def runs(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Runs of equal neighbouring values of each key: ``run`` (from 0), ``value``, ``length``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def longest_run(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Longest run of each key."""
    return runs(df, key, order, value).groupBy(key).agg(F.max("length").alias("longest"))


def tail_run(df: DataFrame, key: str, order: list[Column], hit: Column) -> DataFrame:
    """Rows at the end of each key's sequence that are all hits: their number, 0 where the last row is none.

    An aggregate: rows after the last miss, found as a maximum, are counted; nothing is sorted.
    """
    o, hit = F.struct(*order), F.coalesce(hit, F.lit(False))
    miss = df.groupBy(key).agg(F.max(F.when(~hit, o)).alias("_miss"))
    return df.join(miss, key).groupBy(key).agg(F.count_if(F.col("_miss").isNull() | (o > F.col("_miss"))).alias("tail"))


def cycling(df: DataFrame, key: str, order: list[Column], failed: Column, signature: str, window: int = 5, distinct: int = 2) -> DataFrame:
    """Keys that ever had ``window`` failures in a row, no success between, with at least ``distinct`` signatures."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    seen = df.select(key, F.count_if(failed).over(w).alias("_f"), F.size(F.collect_set(F.when(failed, F.col(signature))).over(w)).alias("_d"))
    return seen.groupBy(key).agg(F.bool_or((F.col("_f") == window) & (F.col("_d") >= distinct)).alias("cycling"))


def error_islands(df: DataFrame, key: str, order: list[Column], error: Column, fix: Column, keep: int = 5) -> DataFrame:
    """Error segments of each key: neighbouring distinct errors open one each; resolved when a fix comes before the next.

    Columns ``island`` (from 1), ``error``, ``resolved``; the first ``keep`` of each key.
    """
    marked = df.select(key, error.alias("error"), fix.alias("_fix"), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    w2 = Window.partitionBy(key).orderBy(*(f"_o{k}" for k in range(len(order))))
    previous = F.last("error", ignorenulls=True).over(w2.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_new", (F.col("error").isNotNull() & ~F.col("error").eqNullSafe(previous)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.where("island > 0").groupBy(key, "island").agg(F.max(F.when(F.col("_new") == 1, F.col("error"))).alias("error"), F.bool_or("_fix").alias("resolved"))
    return islands.where(F.col("island") <= keep)


def followed_by_in(items: Column, first: Column, wanted: str, within: int) -> Column:
    """Whether ``wanted`` is among the ``within`` elements after position ``first`` (from 1); null where first is 0 or null."""
    return F.when(first > 0, F.array_contains(F.slice(items, F.when(first > 0, first + 1).otherwise(F.lit(1)), F.lit(within)), wanted))


def first_where_in(items: Column, test) -> Column:
    """Position (from 1) of the first element that passes ``test``; 0 if none does."""
    hits = F.transform(items, lambda x: F.coalesce(test(x), F.lit(False)))
    return F.array_position(hits, F.lit(True))


def prefix_before_in(steps: Column, write, read, ok) -> Column:
    """Steps up to the last read before the first write, only those that went well; empty if fewer than two are left."""
    n = F.size(steps)
    first = first_where_in(steps, write)
    head = F.slice(steps, F.lit(1), F.when(first > 0, first.cast("int") - 1).otherwise(n))
    reads = F.transform(head, lambda x: F.coalesce(read(x), F.lit(False)))
    last = F.coalesce(F.array_max(F.transform(reads, lambda x, k: F.when(x, k + 1).otherwise(F.lit(0)))), F.lit(0))
    kept = F.filter(F.slice(head, F.lit(1), last), lambda x: F.coalesce(ok(x), F.lit(False)))
    return F.when(F.size(kept) >= 2, kept).otherwise(F.slice(steps, 1, 0))


def kept_before(df: DataFrame, key: str, order: list[Column], kept: Column, name: str = "cut") -> DataFrame:
    """Number of kept rows before each row of its key: where a position of the full sequence falls in the reduced one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.count_if(kept).over(w), F.lit(0)))


#: Ranks up to which Spark limits the rows of a group before it sorts them (its default), and rows up to which a top list is a plain one.
RANKED = 1000


def numbered(df: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the row number ``name`` (from 1) in the total order ``order``, over all rows or ``within`` groups.

    Rows are parted by ranges of group and order and written; a row's number is that within its part plus the rows of
    its group in the parts before. So neither all rows nor a hot group are ever sorted by one task; what one task adds
    up is a number for each part. Null groups are one group. Rows that are equal in ``order`` share a part.
    """
    parts = stored(df.repartitionByRange(*(F.asc(g) for g in within), *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*within, "__part").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = sizes.withColumn("__before", F.sum("__n").over(whole.orderBy("__part")) - F.col("__n"))
    small = before.select(*(F.col(g).alias(f"__w{k}") for k, g in enumerate(within)), F.col("__part").alias("__p"), "__before")
    own = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order))
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(within):
        same = same & F.col(g).eqNullSafe(F.col(f"__w{k}"))
    ranked = parts.withColumn("__own", own).join(small, same)
    return ranked.select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def round_robin(df: DataFrame, group: str, order: list[Column], budget: int, first: Column) -> DataFrame:
    """Rows that a fair draw keeps: one of each group a round, groups by first appearance, until the budget is used.

    ``order`` ranks rows within a group, ``first`` orders groups by its minimum. The draw order is (round, group's
    first). The rounds that fit the budget follow from the groups' sizes alone: n rounds take the sum of min(size, n),
    which is tried for many n at once. What is left goes to groups in order. No task ranks a whole group or all groups
    (see ``numbered``). A budget below 1 keeps nothing.
    """
    sizes = cut(df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.min(first).alias("__f")))
    most, total = sizes.agg(F.coalesce(F.max("__n"), F.lit(0)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    rounds, taken, above = 0, 0, most + 1
    if total <= budget:
        rounds, taken = most, total
    while above - rounds > 1 and taken < budget:  # rounds fit, above don't
        tries = sorted({rounds + max(1, (above - rounds) * k // 32) for k in range(1, 32)} - {above})
        sums = sizes.agg(*(F.sum(F.least("__n", F.lit(n))).alias(f"n{n}") for n in tries)).first()
        fit = [(n, s) for n, s in zip(tries, sums) if s <= budget]
        above = min([n for n, s in zip(tries, sums) if s > budget], default=above)
        if fit:
            rounds, taken = fit[-1]
    last, left = rounds + 1, budget - taken
    if last <= RANKED:  # Spark keeps that many rows of each group before the shuffle, so a hot group is small
        ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("round") <= last)
    else:
        ranked = numbered(df, order, "round", (group,)).where(F.col("round") <= last)
    whole = ranked.where(F.col("round") <= rounds)
    if taken >= min(budget, total):
        return whole
    more = sizes.where(F.col("__n") > rounds)
    some = more.orderBy("__f", "__g").limit(left) if left <= RANKED else numbered(more, [F.col("__f"), F.col("__g")], "__k").where(F.col("__k") <= left)
    return whole.union(ranked.where(F.col("round") == last).join(some.select("__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g"))


def strictly_rising(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Rows whose value isn't above the one before in their key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn("_b", before).where(F.col(value) <= F.col("_b")).drop("_b")


def adaptive_level(outcomes: Column, up: int = 3, down: int = 2, low: int = 1, high: int = 8) -> Column:
    """Level after a sequence of successes (booleans): up after ``up`` in a row, down after ``down`` failures in a row, clamped."""
    start = F.struct(F.lit(low).alias("level"), F.lit(0).alias("good"), F.lit(0).alias("bad"))

    def step(a: Column, ok: Column) -> Column:
        good, bad = F.when(ok, a["good"] + 1).otherwise(F.lit(0)), F.when(ok, F.lit(0)).otherwise(a["bad"] + 1)
        rise, fall = good >= up, bad >= down
        level = F.when(rise, F.least(a["level"] + 1, F.lit(high))).when(fall, F.greatest(a["level"] - 1, F.lit(low))).otherwise(a["level"])
        return F.struct(level.alias("level"), F.when(rise, F.lit(0)).otherwise(good).alias("good"), F.when(fall, F.lit(0)).otherwise(bad).alias("bad"))

    return F.coalesce(F.reduce(outcomes, start, step, lambda a: a["level"]), F.lit(low))


def reverted_in(edits: Column) -> Column:
    """Whether an array of ``struct(a, b)`` holds an edit and later its inverse."""
    keyed = F.transform(edits, lambda e, k: F.struct(k.alias("k"), e["a"].alias("a"), e["b"].alias("b")))
    return F.exists(keyed, lambda x: F.exists(keyed, lambda y: (y["k"] > x["k"]) & (y["a"] == x["b"]) & (y["b"] == x["a"]) & (x["a"] != x["b"])))


def proved_by_tests_in(codes: Column, least: int = 3) -> Column:
    """Whether an array of exit codes has ``least`` runs, ends in 0 and was not 0 before."""
    return (F.size(codes) >= least) & (F.element_at(codes, -1) == 0) & F.exists(codes, lambda c: c != 0)


def budgeted_latest(df: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Newest rows of each key whose sizes fit a budget; the newest is kept in any case."""
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_t", total).withColumn("_k", F.row_number().over(w)).where((F.col("_t") <= budget) | (F.col("_k") == 1)).drop("_t", "_k")
