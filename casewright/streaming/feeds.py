"""Feeds: subscriptions that begin with what has been, digests of what changed, levels kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casewright.operators.sequences import adaptive_level
from casewright.sources.text import markdown_sections


def subscription(spark: SparkSession, folder: str, ddl: str, after: int = 0, files: int = 100) -> DataFrame:
    """Stream of the events in a folder of Parquet files with ``seq`` above ``after``: what is there first, then what comes.

    The order within a stream of events is that of ``seq``; files are taken ``files`` at a time, so a long past is read in steps.
    """
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(folder).where(F.col("seq") > after)


def digest_changes(changes: DataFrame, texts: DataFrame, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sections, ledger) after changes (``path``, ``change``): new and changed markdown is read into sections; every file that is there
    has its hash recorded, removed ones leave."""
    there = texts.join(changes.where("change <> 'removed'").select(path).distinct(), path, "left_semi")
    sections = markdown_sections(there.where(F.lower(path).endswith(".md")), path, text)
    return sections, there.select(path, F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"))


def level_fold(outcomes: Iterator[bool], state: tuple[int, int, int], up: int, down: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(level, successes in a row, failures in a row) after each outcome."""
    level, good, bad = state
    for ok in outcomes:
        good, bad = (good + 1, 0) if ok else (0, bad + 1)
        if good >= up:
            level, good = min(level + 1, high), 0
        elif bad >= down:
            level, bad = max(level - 1, low), 0
        yield level, good, bad


def mastery(events: DataFrame, key: str, seq: str, ok: str, up: int = 3, down: int = 2, low: int = 1, high: int = 8) -> DataFrame:
    """Level of each key after every event of a stream; events of a key must arrive in ``seq`` order between batches. State is three numbers a key."""
    source = events.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(ok).alias("ok"))
    kind = source.schema["key"].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = tuple(state.get) if state.exists else (low, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        levels = []
        for at in level_fold(rows["ok"], at, up, down, low, high):
            levels.append(at[0])
        state.update(at)
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "level": levels})

    return source.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq bigint, level int", "level int, good int, bad int", "append", GroupStateTimeout.NoTimeout)


def mastery_batch(events: DataFrame, key: str, order: list[Column], ok: str, **how: int) -> DataFrame:
    """Last level of each key over a table. Outcomes are gathered a key: for keys whose past is bounded (else keep the stream)."""
    rows = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(ok).alias("_ok")))), lambda x: x["_ok"]).alias("_l"))
    return rows.select(key, adaptive_level(F.col("_l"), **how).alias("level"))
