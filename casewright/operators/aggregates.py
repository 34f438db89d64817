"""Aggregations over cases, records and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import CATEGORIES, normal_goal, parse_stamp, strip, subject_of, subject_text


def upsert(observations: DataFrame, key: str, order: list[Column], value: list[str]) -> DataFrame:
    """Store after all observations in order: one row a key with its count, first and last order and the last values."""
    last = F.max_by(F.struct(*value), F.struct(*order))
    return observations.groupBy(key).agg(F.count("*").alias("times_seen"), F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"), last.alias("_l")).select(
        key, "times_seen", "first_seen", "last_seen", *(F.col(f"_l.{v}").alias(v) for v in value)
    )


def merge_import(live: DataFrame, incoming: DataFrame, key: str = "signature", count: str = "times_seen") -> DataFrame:
    """Live store after an import in merge mode: known keys add their counts, unknown ones come in; ``added`` says which."""
    new = incoming.groupBy(key).agg(F.sum(count).alias("_in"))
    both = live.join(new, key, "full")
    return both.select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_in", F.lit(0))).alias(count), F.col(count).isNull().alias("added"))


def merge_pairs(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cases after merging sources into targets (``target``, ``source`` ids): counts add up, the newer sighting wins strictly, sources leave."""
    src = cases.select(F.col("id").alias("source"), F.col("times_seen").alias("_n"), F.col("last_seen").alias("_l")).join(pairs, "source")
    add = src.groupBy(F.col("target").alias("id")).agg(F.sum("_n").alias("_n"), F.max_by("_l", F.struct(parse_stamp(F.col("_l")), "_l")).alias("_l"), F.min("source").alias("merged_from_new"))
    left = cases.join(pairs.select(F.col("source").alias("id")), "id", "left_anti").join(add, "id", "left")
    newer = parse_stamp(F.col("_l")) > parse_stamp(F.col("last_seen"))
    return left.select(
        "id", "signature", (F.col("times_seen") + F.coalesce("_n", F.lit(0))).alias("times_seen"), F.when(newer, F.col("_l")).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("merged_from_new", "merged_from").alias("merged_from")
    )


def recurring(cases: DataFrame, least: int = 3, sure: int = 20) -> DataFrame:
    """Cases seen at least ``least`` times with a confidence that reaches 1 at ``sure``."""
    return cases.where(F.col("times_seen") >= least).withColumn("confidence", F.round(F.least(F.col("times_seen") / sure, F.lit(1.0)), 3))


def clusters(cases: DataFrame, text: str, key: str = "id", chars: int = 80, least: int = 2, sure: int = 5) -> DataFrame:
    """Cases whose text begins alike: cut to ``chars``, lower case, stripped. Size, smallest and largest id, confidence; empty keys form no cluster."""
    k = strip(F.lower(F.substring(text, 1, chars)))
    g = cases.groupBy(k.alias("cluster")).agg(F.count("*").alias("size"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return g.where((F.col("size") >= least) & (F.col("cluster") != "")).withColumn("confidence", F.round(F.least(F.col("size") / sure, F.lit(1.0)), 3))


def category_gaps(cases: DataFrame, thin: int = 3) -> DataFrame:
    """Number of cases of every category, zero included, and whether it is empty, thin or covered."""
    spark = cases.sparkSession
    all_ = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    texts = cases.select(subject_text(F.col("signature"), F.col("error_excerpt")).alias("_t"))
    n = texts.groupBy(subject_of(F.col("_t")).alias("category")).agg(F.count("*").alias("cases"))
    out = all_.join(n, "category", "left").withColumn("cases", F.coalesce("cases", F.lit(0)))
    return out.withColumn("status", F.when(F.col("cases") == 0, "empty").when(F.col("cases") < thin, "thin").otherwise("covered"))


def gap_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Categories whose count rose and whose status changed between two states."""
    a, b = category_gaps(before), category_gaps(after)
    both = a.select("category", F.col("cases").alias("before"), F.col("status").alias("was")).join(b.select("category", F.col("cases").alias("after"), F.col("status").alias("is")), "category")
    return both.where((F.col("after") > F.col("before")) & (F.col("was") != F.col("is")))


def tally(df: DataFrame, column: str, total: str = "n") -> DataFrame:
    """Rows of every value, null included."""
    return df.groupBy(column).agg(F.count("*").alias(total))


def exploded_tally(df: DataFrame, column: str, name: str) -> DataFrame:
    """Occurrences of every element of an array column."""
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def rarity(df: DataFrame, group: list[str], name: str = "diversity") -> DataFrame:
    """``1 - share`` of each row's group among all rows, on four digits; group counts are joined back, the total is one row."""
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    share = n.crossJoin(F.broadcast(total)).select(*group, F.round(1 - F.col("_n") / F.col("_all"), 4).alias(name))  # total is a single row
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}"))
    return df.alias("d").join(share.alias("s"), same).select("d.*", F.col(f"s.{name}"))


def mean_known(dims: dict[str, Column]) -> tuple[Column, Column]:
    """(mean over the dimensions that aren't null on four digits or 0, names of the null ones)."""
    known = F.filter(F.array(*dims.values()), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.round(F.reduce(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 4)).otherwise(0.0)
    unknown = F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in dims.items())), lambda x: x.isNotNull())
    return mean, unknown


def newest_per_goal(df: DataFrame, goal: str, order: list[Column]) -> DataFrame:
    """Every row with ``superseded``: whether a later row has the same normalised goal; the latest is found by an aggregate."""
    g = normal_goal(F.col(goal))
    best = df.groupBy(g.alias("_g")).agg(F.max(F.struct(*order)).alias("_best"))
    return df.withColumn("_g", g).join(best, "_g").withColumn("superseded", F.struct(*order) < F.col("_best")).drop("_g", "_best")


def merge_goals(df: DataFrame, goal: str, rank: list[Column], key: str, times: str) -> DataFrame:
    """Winner of every normalised goal (largest ``rank``) with the sightings of all and the number it absorbed."""
    return df.groupBy(normal_goal(F.col(goal)).alias("goal_key")).agg(F.max_by(key, F.struct(*rank)).alias("winner"), F.sum(times).alias("times_seen"), (F.count("*") - 1).alias("absorbed"))


def run_metrics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation aggregates: tasks, successes, rate, mean iterations and duration; ``success``, ``iterations``, ``duration`` are read."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        F.count_if("success").alias("successes"),
        F.round(F.count_if("success") / F.count("*"), 3).alias("rate"),
        F.round(F.avg("iterations"), 1).alias("avg_iterations"),
        F.round(F.avg("duration"), 1).alias("avg_duration"),
    )


def compare_runs(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys in both runs whose success changed: regression or improvement."""
    a, b = before.select(*key, F.col("success").alias("_a")), after.select(*key, F.col("success").alias("_b"))
    kind = F.when(F.col("_a") & ~F.col("_b"), "regression").when(~F.col("_a") & F.col("_b"), "improvement")
    return a.join(b, key).select(*key, kind.alias("change")).where("change IS NOT NULL")


def dedupe_by_hash(df: DataFrame, text: str, key: str) -> DataFrame:
    """Smallest key and copies of every distinct stripped text, by SHA-256; null texts are left out."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(strip(F.col(text)), 256).alias("content_hash")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))


def longest_per_key(df: DataFrame, key: Column, text: str, tie: list[Column]) -> DataFrame:
    """Longest text of every key; the first by ``tie`` wins among equals."""
    w = Window.partitionBy("_k").orderBy(F.desc(F.length(text)), *tie)
    return df.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("_k", "key")
