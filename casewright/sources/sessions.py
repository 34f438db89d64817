"""Experiences mined from session tables: messages, parts, transcripts.

Tables (not a database driver) are the input: ``session(id, directory, title, time_created)``,
``message(id, session_id, time_created, data)``, ``part(id, message_id, session_id, time_created, data)`` with JSON
data, and transcripts as one JSON array of messages a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import is_continuation, present, shorten, strip

PART = "type STRING, text STRING, tool STRING, state STRUCT<status: STRING, output: STRING, error: STRING>"
TRANSCRIPT = f"ARRAY<STRUCT<info: STRUCT<role: STRING>, parts: ARRAY<STRUCT<{PART}>>>>"
#: Actions kept of a session, parts that make a session without goal worth keeping, and islands kept.
ACTIONS, WORTH, ISLANDS = 50, 100, 5
#: Confidence of a mined record by the state of its session.
CONFIDENCE = {"done": 0.45}
MINED = 0.3


def session_volume(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """``id``, ``message_count``, ``part_count`` of every session; counts are combined before the shuffle."""
    count = lambda t, n: t.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(n))
    both = session.select("id").join(count(message, "message_count"), "id", "left").join(count(part, "part_count"), "id", "left")
    return both.fillna(0, ["message_count", "part_count"])


def parts_with_role(message: DataFrame, part: DataFrame) -> DataFrame:
    """Parts in typed columns with the role of their message (null where the message is unknown)."""
    role = message.select(F.col("id").alias("message_id"), F.get_json_object("data", "$.role").alias("role"))
    p = part.select("id", "message_id", "session_id", "time_created", F.from_json("data", PART).alias("d"))
    return p.join(role, "message_id", "left").select("session_id", "time_created", "id", "role", "d.*")


def first_goal(parts: DataFrame, session: str = "session_id") -> DataFrame:
    """Goal of every session: its earliest user text that says something, shortened at a word."""
    said = parts.where((F.col("role") == "user") & present(strip(F.col("text"))) & ~is_continuation(F.col("text")))
    first = said.groupBy(session).agg(F.min_by("text", F.struct("time_created", "id")).alias("t"))
    return first.select(session, shorten(strip(F.col("t"))).alias("goal"))


def tool_actions(parts: DataFrame, session: str = "session_id", keep: int = ACTIONS) -> DataFrame:
    """``actions`` (the first ``keep`` tool names in order) and ``tool_count`` (all) of every session.

    The count is an aggregate; only the first names are collected, ranked within the session, so no row grows with it.
    """
    used = parts.where("tool IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy(session).orderBy("time_created", "id")))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= keep, F.struct("_k", "tool")))), lambda x: x["tool"])
    return used.groupBy(session).agg(names.alias("actions"), F.count("*").alias("tool_count"))


def as_experiences(session: DataFrame, volume: DataFrame, goals: DataFrame, actions: DataFrame, source: str, confidence: Column | None = None) -> DataFrame:
    """Mined records: outcome partial; sessions without goal get a placeholder if they have enough parts, else are left out."""
    all_ = session.join(volume, "id").join(goals.withColumnRenamed("session_id", "id"), "id", "left").join(actions.withColumnRenamed("session_id", "id"), "id", "left")
    kept = all_.where(F.col("goal").isNotNull() | (F.col("part_count") >= WORTH))
    return kept.select(
        F.sha2(F.concat(F.lit(source), F.lit(":"), F.col("id").cast("string")), 256).substr(1, 32).alias("experience_id"),
        F.col("id").alias("session_id"),
        F.coalesce("goal", F.concat(F.lit("continued prior work in "), F.col("directory"))).alias("goal"),
        F.lit("partial").alias("outcome"),
        F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
        F.coalesce("tool_count", F.lit(0)).alias("tool_count"),
        "message_count",
        "part_count",
        (confidence if confidence is not None else F.lit(MINED)).alias("confidence"),
        F.lit(source).alias("source"),
    )


def mine_stats(session: DataFrame, mined: DataFrame) -> DataFrame:
    """``directory``, ``seen``, ``mined`` with a row for the total (null directory)."""
    hit = mined.select(F.col("session_id").alias("id"), F.lit(1).alias("m"))
    return session.join(hit, "id", "left").rollup("directory").agg(F.count("*").alias("seen"), F.count("m").alias("mined"))


def transcript_parts(transcripts: DataFrame, session: str = "session_id", transcript: str = "transcript") -> DataFrame:
    """Messages and parts of JSON transcripts in order, with the message's role; a text that is no array gives no row."""
    rows = transcripts.select(session, F.posexplode(F.from_json(transcript, TRANSCRIPT)).alias("m", "x"))
    each = rows.select(session, "m", F.col("x.info.role").alias("role"), F.posexplode("x.parts").alias("p", "d"))
    return each.select(session, (F.col("m") * 100_000 + F.col("p")).alias("time_created"), F.col("p").alias("id"), "role", "d.*")


def status_confidence(status: Column) -> Column:
    """Confidence of a mined transcript by its session's status."""
    out = None
    for name, value in CONFIDENCE.items():
        out = F.when(status == name, value) if out is None else out.when(status == name, value)
    return out.otherwise(F.lit(MINED))
