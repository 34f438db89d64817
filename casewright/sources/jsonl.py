"""JSON Lines scans: strict, lenient and defaulted.

Files are read by splits. Lines get their numbers from the place in their split and the counts of the splits before, and
all checks are columns; no task sees more than its split.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.sources import schemas


class RecordError(ValueError):
    """A line that a strict scan refuses; the message names the first one."""


class EmptyHoldout(ValueError):
    """A frozen test set without entries."""


def lines(spark: SparkSession, path: str, bom: bool = True) -> DataFrame:
    """``file``, ``block`` (where its split begins), ``line_no`` (from 1) and ``line`` of text files; byte order mark off,
    CRLF as LF, blank lines left out but counted."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*at, F.monotonically_increasing_id().alias("k"), "value")
    # lines of a split stand together and in order; a file has few splits, so what comes before each is a small window
    splits = rows.groupBy("file", "block").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    number = F.col("k") - F.col("first") + F.col("before") + 1
    text = F.regexp_replace("value", "\r$", "")
    text = F.when(number == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text) if bom else text
    return numbered.select("file", "block", number.alias("line_no"), text.alias("line")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def _kind(raw: Column) -> Column:
    """Type of a variant value: BIGINT, STRING, BOOLEAN, ... VOID for null."""
    return F.schema_of_variant(raw)


def type_errors(schema: T.StructType, required: list[str], nullable: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """Checks of a parsed line (variant): required fields present, integers no booleans or fractions, texts texts."""
    wanted = {"bigint": ["BIGINT"], "string": ["STRING"], "double": ["DOUBLE", "BIGINT", "DECIMAL"], "boolean": ["BOOLEAN"]}

    def check(v: Column) -> Column:
        found = []
        for f in schema:
            if f.name not in required and f.name not in nullable:
                continue
            raw = F.try_variant_get(v, f"$.{f.name}", "variant")
            kind = _kind(raw)
            missing = raw.isNull() if f.name in required else F.lit(False)
            void = kind == "VOID" if f.name in required else F.lit(False)
            names = wanted.get(f.dataType.simpleString(), ["ARRAY", "OBJECT"])
            wrong = raw.isNotNull() & (kind != "VOID") & ~kind.rlike("^(?:" + "|".join(names) + ")")
            found += [F.when(missing, F.lit(f"missing {f.name}")), F.when(void | wrong, F.lit(f"bad type of {f.name}"))]
        return F.coalesce(*found)

    return check


CASE_CHECKS = [("id < 1", "id below 1"), ("times_seen < 1", "times_seen below 1"), ("try_to_timestamp(last_seen) IS NULL", "last_seen is no ISO-8601 stamp")]
FLAKE_CHECKS = [("times_passed < 1", "times_passed below 1"), ("try_to_timestamp(last_pass) IS NULL", "last_pass is no ISO-8601 stamp")]
TASK_CHECKS = [("id < 0", "id below 0"), ("status NOT IN ('todo', 'done')", "unknown status"), ("trim(title) = ''", "empty title")]
EXPERIENCE_CHECKS = [
    ("trim(coalesce(goal, '')) = ''", "no goal"),
    ("outcome IS NULL OR outcome NOT IN ('success', 'failed', 'recovered', 'partial', 'human_corrected')", "unknown outcome"),
    ("confidence < 0 OR confidence > 1", "confidence beyond 0 to 1"),
    ("times_seen < 1", "times_seen below 1"),
]


def checked(rows: DataFrame, ddl: str, required: list[str], checks: list[tuple[str, str]] = (), rising_id: bool = False, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Parsed columns of ``rows`` (line_no, line) with ``error``: the first fault of a line, or null."""
    schema = T._parse_datatype_string(ddl)
    parsed = rows.select("file", "block", "line_no", "line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("line").alias("v"))
    types = type_errors(schema, required, nullable)("v") if required or nullable else F.lit(None).cast("string")
    flat = parsed.select("file", "block", "line_no", "r.*", F.when(F.col("v").isNull() | ~_kind("v").startswith("OBJECT"), F.lit("not a JSON object")).otherwise(types).alias("_type"))
    error = F.coalesce("_type", *(F.when(F.expr(test), F.lit(text)) for test, text in checks))
    if rising_id:  # the line before is in the same split, or the last one of the split before
        last = flat.groupBy("file", "block").agg(F.max_by("id", "line_no").alias("_id"))
        edge = last.select("file", "block", F.lag("_id").over(Window.partitionBy("file").orderBy("block")).alias("_edge"))
        before = F.coalesce(F.lag("id").over(Window.partitionBy("file", "block").orderBy("line_no")), "_edge")
        flat = flat.join(edge, ["file", "block"]).withColumn("_before", before).drop("_edge")
        error = F.coalesce(error, F.when(F.col("id") <= F.col("_before"), F.lit("ids must rise")))
        return flat.withColumn("error", error).drop("_type", "_before")
    return flat.withColumn("error", error).drop("_type")


def strict(rows: DataFrame, ddl: str, required: list[str], checks: list[tuple[str, str]] = (), rising_id: bool = False, nullable: tuple[str, ...] = (), name: str = "file") -> DataFrame:
    """The records of a file, or RecordError with the first bad line; an empty file is an empty frame."""
    done = checked(rows, ddl, required, checks, rising_id, nullable)
    bad = done.where("error IS NOT NULL").agg(F.min(F.struct("line_no", "error")).alias("b")).first()["b"]
    if bad:
        raise RecordError(f"{name}: line {bad['line_no']}: {bad['error']}")
    return done.drop("error", "file", "block", "line_no")


def lenient(rows: DataFrame, ddl: str) -> DataFrame:
    """The records of a file, or none at all if any line is bad."""
    done = checked(rows, ddl, [])
    bad = done.where("error IS NOT NULL").agg(F.count("*").alias("_bad"))
    return done.crossJoin(F.broadcast(bad)).where("_bad = 0").drop("_bad", "error", "file", "block", "line_no")  # one row by construction


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _records(spark: SparkSession, path: str, ddl: str, required: list[str], checks=(), rising_id=False, nullable=(), bom=True) -> DataFrame:
    if not _there(spark, path):
        return spark.createDataFrame([], ddl)
    return strict(lines(spark, path, bom), ddl, required, checks, rising_id, nullable, os.path.basename(path))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The case base; a missing file is empty, the first malformed line raises, ids must rise in file order."""
    return _records(spark, path, schemas.CASE, ["id", "signature", "error_excerpt", "diagnosis", "times_seen", "last_seen", "confirmed_by"], CASE_CHECKS, True)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks; ``done_at`` may be null."""
    return _records(spark, path, schemas.TASK, ["id", "title", "status", "created"], TASK_CHECKS, True, ("done_at",))


def read_flakes(spark: SparkSession, path: str) -> DataFrame:
    """The log of observed passes."""
    return _records(spark, path, schemas.FLAKE, ["signature", "times_passed", "last_pass"], FLAKE_CHECKS)


def read_proposed_rules(spark: SparkSession, path: str) -> DataFrame:
    """Proposed rules; a byte order mark is an error."""
    required = ["id", "type", "description", "confidence", "supporting_cases", "proposed_rule", "created"]
    return _records(spark, path, schemas.PROPOSED_RULE, required, bom=False)


def read_rejected_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rules; ``rejected_by`` may be null."""
    return _records(spark, path, schemas.REJECTED_RULE, ["type", "supporting_cases", "rejected_at", "reason"], nullable=("rejected_by",))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Digest sections; only the syntax is checked."""
    return _records(spark, path, schemas.DIGEST, [])


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """The frozen test set; a missing file raises FileNotFoundError, an empty one EmptyHoldout."""
    if not _there(spark, path):
        raise FileNotFoundError(path)
    out = _records(spark, path, schemas.HOLDOUT, ["signature", "diagnosis"])
    if out.isEmpty():
        raise EmptyHoldout(path)
    return out


def read_experiences(spark: SparkSession, path: str) -> DataFrame:
    """Experiences; missing fields get defaults, goal and outcome are required; ``context`` stays JSON text."""
    out = _records(spark, path, schemas.EXPERIENCE, [], EXPERIENCE_CHECKS)
    empty = F.array().cast("array<string>")
    return out.withColumns(
        {c: F.coalesce(c, empty) for c in ("actions", "tags", "languages")}
        | {"context": F.coalesce("context", F.lit("{}")), "confidence": F.coalesce("confidence", F.lit(0.5)), "times_seen": F.coalesce("times_seen", F.lit(1).cast("bigint"))}
    )


def read_lenient(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of a file of any schema; empty if the file is missing or any line is malformed."""
    return lenient(lines(spark, path), ddl) if _there(spark, path) else spark.createDataFrame([], ddl)


def read_eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs (one JSON document a file) as one row for each run, model and task."""
    runs = spark.read.schema(schemas.EVAL_RUN).option("multiLine", True).json(path)
    by_model = runs.select("run_id", "started_at", F.explode("results").alias("model", "tasks"))
    return by_model.select("run_id", "started_at", "model", F.explode("tasks").alias("task", "m")).select("run_id", "started_at", "model", "task", *(f"m.{c}" for c in ("success", "termination_reason", "iterations", "duration_seconds", "files_changed", "tool_calls", "commands_run", "tool_failures", "recovery_count", "intervention_count")))


def read_rule_packs(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all packs below a path, with ``error`` where a pack or rule is unusable; bad packs are no failure."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("pack"), F.regexp_replace("value", "^﻿", "").alias("t"))
    packs = raw.select("pack", F.from_json("t", schemas.RULE_PACK, {"mode": "PERMISSIVE"}).alias("p"), F.try_parse_json("t").alias("v"))
    rows = packs.select("pack", F.when(F.col("v").isNull(), F.lit("not JSON")).when(F.col("p.rules").isNull(), F.lit("no rules")).alias("bad"), "p.name", "p.version", F.explode_outer("p.rules").alias("r"))
    error = F.coalesce("bad", F.when(F.col("r.pattern").isNull() | (F.length("r.pattern") > 1000), F.lit("no pattern or too long")), F.when((F.col("r.exit_code") < 0) | (F.col("r.exit_code") > 255), F.lit("exit code beyond 0 to 255")))
    return rows.select("pack", "name", "version", "r.*", error.alias("error")).drop("bad")


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skills of a folder (one JSON a file) with ``error`` for names or fields that aren't valid."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schemas.SKILL, {"mode": "PERMISSIVE"}).alias("s"), F.try_parse_json("value").alias("v"))
    error = F.when(F.col("v").isNull(), F.lit("not JSON")).when(~F.coalesce(F.col("s.name").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)), F.lit("bad name")).when(F.col("s.goal").isNull(), F.lit("no goal"))
    return raw.select("file", "s.*", error.alias("error"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a manifest: ``path``, ``size``, ``sha256``; RecordError if it has no list of files."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.MANIFEST).alias("m"))
    if whole.where("m.files IS NOT NULL").isEmpty():
        raise RecordError(f"{os.path.basename(path)}: no list of files")
    return whole.select(F.explode("m.files").alias("f")).select("f.*")


def read_ledger(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """``path``, ``sha256`` of a scan ledger; empty where it is missing, corrupt or of another version, so all is scanned anew."""
    ddl = "version INT, last_scan STRING, files MAP<STRING, STRUCT<sha256: STRING, last_digested: STRING, size: BIGINT>>"
    empty = spark.createDataFrame([], "path STRING, sha256 STRING")
    if not _there(spark, path):
        return empty
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", ddl, {"mode": "PERMISSIVE"}).alias("l")).where(F.col("l.version") == version)
    return whole.select(F.explode("l.files").alias("path", "f")).select("path", F.col("f.sha256").alias("sha256"))
