"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.credentials import find_credentials
from casewright.llm.encode import encode_column
from casewright.llm.formatting import collapse_formatting
from casewright.llm.leakage import leaked_items
from casewright.llm.neardup import near_duplicates
from casewright.llm.pairs import defective_pairs
from casewright.llm.residue import residue_values
from casewright.llm.stuffing import stuffed_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose diagnosis or goal is residue, to be excluded."""
    cases = _read(spark, sf_dir, "cases").select(F.lit("cases").alias("rec_table"), F.col("id").cast("string").alias("rec_key"), F.col("diagnosis").alias("value"))
    goals = _read(spark, sf_dir, "experiences").select(F.lit("experiences").alias("rec_table"), F.col("experience_id").alias("rec_key"), F.col("goal").alias("value"))
    return residue_values(cases.union(goals), ["rec_table", "rec_key"], "value").select("rec_table", "rec_key").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that repeat an earlier one in another spelling or exactly."""
    _, members = collapse_formatting(_read(spark, sf_dir, "cases"), "id", ["signature"], ["error_excerpt"], single=False)
    return members.where("id <> first_id").select("first_id", "id")


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct case with its copies and spellings."""
    groups, _ = collapse_formatting(_read(spark, sf_dir, "cases"), "id", ["signature"], ["error_excerpt"])
    return groups


def _credentials(spark: SparkSession, sf_dir: str, redacted: bool) -> DataFrame:
    one = _read(spark, sf_dir, "experiences").select(F.lit("experiences").alias("rec_table"), F.col("experience_id").alias("rec_key"), "failure", "resolution")
    two = _read(spark, sf_dir, "trajectories").select(
        F.lit("trajectories").alias("rec_table"), F.col("traj_id").cast("string").alias("rec_key"), "final_answer"
    )
    keep = ["rec_table", "rec_key"]
    found = find_credentials(one, {"failure": "failure", "resolution": "resolution"}, keep, redacted)
    return found.union(find_credentials(two, {"final_answer": "final_answer"}, keep, redacted))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold a live credential."""
    return _credentials(spark, sf_dir, False).select("rec_table", "rec_key", "field_name").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields concerned with only their credentials replaced."""
    return _credentials(spark, sf_dir, True).select("rec_table", "rec_key", "field_name", "redacted").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reworded copies among experiences: every member of a group but its smallest id."""
    records = _read(spark, sf_dir, "experiences").where("diagnosis IS NOT NULL")
    text = F.concat(F.coalesce("goal", F.lit("")), F.lit(" "), "diagnosis")
    classes = near_duplicates(records, "experience_id", text, shingle=3, threshold=0.5)
    return classes.where("experience_id <> first_id").select("first_id", "experience_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of goal and final answer."""
    return defective_pairs(_read(spark, sf_dir, "trajectories"), "traj_id", "goal", "final_answer").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text."""
    return encode_column(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the holdout items that leaked into them."""
    return leaked_items(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "holdout"), "item_id", "diagnosis")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links or product tags."""
    return stuffed_pages(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_copies, p3_found, p3_redacted, p4_found, p5_found, p6_ids, p7_found, p8_found)}
