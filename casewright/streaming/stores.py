"""Stores kept up to date from streams.

Counts and last values are built-in streaming aggregates in update mode, written by key through ``foreachBatch``; the
failure ladder, whose state depends on the order of events, is a stateful operator. Event time bounds nothing by
default: a store is as old as its keys. Sinks are idempotent: a batch is written to its own folder, so one that is run
again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def case_store(events: DataFrame, key: Column, at: Column, value: Column) -> DataFrame:
    """Store of failures: count, first and last sighting, value of the last; batch or stream."""
    return (
        events.select(key.alias("signature"), at.alias("at"), value.alias("value"))
        .groupBy("signature")
        .agg(F.count("*").alias("times_seen"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("value", F.struct("at", "value")).alias("value"))
    )


def pass_counter(passes: DataFrame, key: Column, at: Column) -> DataFrame:
    """Passes of each signature with the last one; batch or stream."""
    return passes.select(key.alias("signature"), at.alias("at")).groupBy("signature").agg(F.count("*").alias("times_passed"), F.max("at").alias("last_pass"))


#: Strategy of a failure streak: (failures in a row, distinct signatures among the last five) to its name, first match wins.
LADDER = [("stop", 6, 1), ("replan", 4, 2), ("rediagnose", 3, 1), ("retry", 1, 1)]


def strategy(streak: int, distinct: int) -> str:
    """What to do after so many failures in a row with so many different signatures."""
    return next((name for name, least, kinds in LADDER if streak >= least and distinct >= kinds), "continue")


def ladder_fold(rows: Iterator[tuple[bool, str]], state: tuple[int, list[str], int]) -> Iterator[tuple[int, str, tuple[int, list[str], int]]]:
    """(streak, strategy, state) after each event ``(ok, signature)``; escalation only goes up until a success."""
    streak, recent, step = state
    names = ["continue", *(n for n, _, _ in reversed(LADDER))]
    for ok, signature in rows:
        if ok:
            streak, recent, step = 0, [], 0
        else:
            streak, recent = streak + 1, [*recent, signature][-5:]
            step = max(step, names.index(strategy(streak, len(set(recent)))))
        yield streak, names[step], (streak, recent, step)


def failure_ladder(events: DataFrame, key: str, seq: str, ok: str, signature: str) -> DataFrame:
    """Streak and strategy after every event of each session, on a stream; events of a session must arrive in ``seq`` order
    between batches, within one they are sorted. State is one small row a session."""
    source = events.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(ok).alias("ok"), F.col(signature).alias("signature"))
    kind = source.schema["key"].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = (state.get[0], list(state.get[1]), state.get[2]) if state.exists else (0, [], 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, (streak, name, at) in zip(rows["seq"], ladder_fold(zip(rows["ok"], rows["signature"]), at)):
            out.append((k[0], s, streak, name))
        state.update((at[0], at[1], at[2]))
        yield pd.DataFrame(out, columns=["key", "seq", "streak", "strategy"])

    out = f"key {kind}, seq bigint, streak int, strategy string"
    return source.groupBy("key").applyInPandasWithState(step, out, "streak int, recent array<string>, step int", "append", GroupStateTimeout.NoTimeout)


def failure_ladder_batch(events: DataFrame, key: str, seq: str, ok: str, signature: str) -> DataFrame:
    """The same over a table: streaks by window, strategies by a running maximum; no Python."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(seq)
    good = F.count_if(ok).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = events.select(key, seq, ok, signature, good.alias("_g"))
    inside = Window.partitionBy(key, "_g").orderBy(seq)
    e = e.withColumn("streak", F.count_if(~F.col(ok)).over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    e = e.withColumn("_d", F.size(F.collect_set(F.when(~F.col(ok), F.col(signature))).over(inside.rowsBetween(-4, 0))))
    step = F.lit(0)
    for k, (_, least, kinds) in enumerate(reversed(LADDER), 1):
        step = F.when((F.col("streak") >= least) & (F.col("_d") >= kinds), F.lit(k)).otherwise(step)
    names = F.array(F.lit("continue"), *(F.lit(n) for n, _, _ in reversed(LADDER)))
    top = F.max(step).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("_s", top).select(F.col(key).alias("key"), F.col(seq).alias("seq"), "streak", F.try_element_at(names, F.col("_s") + 1).alias("strategy"))


def write_store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every update of a store to its batch's folder; read it back with ``read_store``."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark, path: str, key: str = "signature") -> DataFrame:
    """The latest row of each key of a written store."""
    all_ = spark.read.option("recursiveFileLookup", True).parquet(path)
    row = F.struct(*(c for c in all_.columns if c != "_batch"))
    return all_.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, "_batch").alias("r")).select("r.*")


def numbered_events(events: DataFrame, stream: str, order: list[Column]) -> DataFrame:
    """Events with ``seq``, rising from 1 in each stream."""
    from pyspark.sql import Window

    return events.withColumn("seq", F.row_number().over(Window.partitionBy(stream).orderBy(*order)))


def history(events: DataFrame, stream: str, last: int = 10_000) -> DataFrame:
    """The last events of each stream that a late subscriber gets."""
    top = events.groupBy(stream).agg(F.max("seq").alias("_top"))
    return events.join(top, stream).where(F.col("seq") > F.col("_top") - last).drop("_top")


def change_feed(scans: DataFrame, key: str, digest: str, scan: str) -> DataFrame:
    """Changes between successive scans of files: new, changed or removed keys of every scan but the first.

    ``scans`` has one row for each key and scan number; a key that a scan lacks counts as removed there.
    """
    now = scans.select(key, scan, F.col(digest).alias("_now"))
    last = scans.agg(F.max(scan).alias("_last"))
    before = scans.select(key, (F.col(scan) + 1).alias(scan), F.col(digest).alias("_was"))
    both = now.join(before, [key, scan], "full").crossJoin(F.broadcast(last))  # one row
    first = F.min(scan)
    start = scans.agg(first.alias("_first"))
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_was") != F.col("_now"), "changed")
    rows = both.crossJoin(F.broadcast(start)).where((F.col(scan) <= F.col("_last")) & (F.col(scan) > F.col("_first")))
    return rows.select(key, scan, kind.alias("change")).where("change IS NOT NULL")
