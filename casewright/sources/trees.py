"""Listings of files as tables: directories, repositories, configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of configuration files.
CONFIG_SUFFIXES = ["json", "toml", "yaml", "yml", "ini", "cfg"]
#: Entries that a listing shows.
SHOWN = 500


def files_below(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path``, ``size``, ``modified`` of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def entries(paths: DataFrame, path: str, folder: str = "", limit: int = SHOWN) -> DataFrame:
    """``name``, ``is_folder``, ``rank`` of what lies directly in a folder: folders first, then by name whatever the case (a report)."""
    start = f"{folder.rstrip('/')}/" if folder else ""
    below = paths.where(F.col(path).startswith(start)) if start else paths
    rest = F.substring(F.col(path), len(start) + 1, 1 << 30)
    one = below.select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_folder")).where("name <> ''").distinct()
    first = one.orderBy(F.desc("is_folder"), F.lower("name"), "name").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("is_folder"), F.lower("name"), "name")))  # at most ``limit`` rows


def config_files(paths: DataFrame, path: str) -> DataFrame:
    """Paths of configuration files outside of ``.git``."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return paths.where(suffix.isin(CONFIG_SUFFIXES) & ~F.concat(F.lit("/"), F.col(path)).contains("/.git/"))


def repositories(paths: DataFrame, path: str, depth: int = 3) -> DataFrame:
    """``repo`` of every repository whose folder lies at most ``depth`` below the root and in no other repository.

    What lies in another is found by the folders above it: each root meets those of its own prefixes, not all others."""
    root = F.regexp_extract(path, r"^(.*?)/\.git(?:/|$)", 1)
    roots = paths.where(F.col(path).rlike(r"^.+?/\.git(?:/|$)")).select(root.alias("repo")).distinct()
    roots = roots.where(F.size(F.split("repo", "/")) <= depth)
    parts = F.split("repo", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    inner = roots.select("repo", F.explode(above).alias("outer")).join(roots.select(F.col("repo").alias("outer")), "outer", "left_semi").select("repo")
    return roots.join(inner.distinct(), "repo", "left_anti")


def repository_state(branches: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """State of repositories, first that holds: dirty, no remote, diverged, ahead, behind, clean; ``branches`` has ``remote``, ``ahead``, ``behind``."""
    dirty = changes.groupBy(key).agg(F.count("*").alias("_n"))
    state = (
        F.when(F.col("_n") > 0, "dirty").when(~F.col("remote"), "no remote").when((F.col("ahead") > 0) & (F.col("behind") > 0), "diverged").when(F.col("ahead") > 0, "ahead").when(F.col("behind") > 0, "behind").otherwise("clean")
    )
    return branches.join(dirty, key, "left").select(key, state.alias("state"))


def language(path: Column) -> Column:
    """Language of a file by its suffix, else ``text``."""
    from casewright.sources.pages import LANGUAGES

    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit("text"))
