"""Scans of markdown, journals, commit logs, transcripts and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions.text import SEPARATOR, canonical_signature, strip

# Words of a section about a failure, and patterns that find its error line and its diagnosis, in order.
FAILURE_WORDS = (
    r"(?i)(error|fail|bom|enoent|mismatch|corrupt|phantom|"
    r"wrong.*cwd|tool.*missing|version.*mismatch|permission.*denied|"
    r"json.*decode|signature|flake|regression|duplicate|"
    r"parse.*rule|volatile|crash|abort|reject)"
)
ERROR_LINES = [
    r"(?i)(jsondecodeerror:.+?)(?:\"|$|\n)",
    r"(?i)(\bENOENT\b[^\n]*?)(?:\.|$|\n)",
    r"(?i)(FAIL[:\s]+[^\n]+?)(?:\.|$|\n)",
    r"(?i)(fatal:\s*.+?)(?:\"|$|\n)",
    r"(?i)(sha256\s+mismatch[^\n]*?)(?:\.|$|\n)",
    r"(?i)(not a git repository[^\n]*?)(?:\.|$|\n)",
    r"(?i)(permission denied[^\n]*?)(?:\.|$|\n)",
    r"(?i)(command not found[^\n]*?)(?:\.|$|\n)",
    r"(?i)(fileNotFoundError[^\n]*?)(?:\.|$|\n)",
]
DIAGNOSES = [
    r"(?i)(?:diagnosis|root cause|cause|happens when|result of)[:\s]+(.+?)(?:\.|$)",
    r"(?i)(?:Rule|Rationale|Lesson)[:\s]+(.+?)(?:\.|$)",
]
FIX_SUBJECT = r"(?i)^(?:fix|bugfix|hotfix|patch|resolve|correct|repair)[\s:]+"
# How lines begin that state no diagnosis, and words in them.
NO_DIAGNOSIS = (["#", "Status:", "Provenance:", "-"], ["RATIFIED", "IMPLEMENTED", "CLOSED"])
# The name of a test in what stands before a failure.
TEST_NAME = r"(?im)(?:FAILED|FAIL)\s+\(([^)]+)\)|(?:Ran\s+\d+\s+tests?\s+in)|^(test_\w+)"
# What a mined case says where nobody diagnosed it, and its columns when it is exported.
PENDING = "Pending teacher review (mined from transcript)."
MINED = {"id": 0, "times_seen": 1, "last_seen": "2026-01-01T00:00:00Z", "confirmed_by": "archive-mine"}
#: Longest excerpt and diagnosis that a mined case keeps.
LONGEST = 4000


def markdown_sections(docs: DataFrame, path: str, text: str) -> DataFrame:
    """Sections of markdown texts: ``path``, ``pos``, ``heading``, ``content``.

    A line that starts with # opens a section with that heading; text before the first one goes under the file's stem;
    sections without text are left out; a text without any gives one row ``(empty document)``. Null texts count as
    empty. Everything happens inside a row, so no shuffle.
    """
    stem = F.regexp_extract(F.col("p"), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    marked = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("t", F.lit("")), "\r\n", "\n"))
    base = docs.select(F.col(path).alias("p"), F.col(text).alias("t")).select("p", F.split(marked, r"\n(?=#)").alias("parts"), stem.alias("stem"))
    part = lambda k, x: F.struct(
        F.when(x.rlike("^#"), strip(F.regexp_replace(F.regexp_extract(x, r"^#+([^\n]*)", 1), r"^\s+", ""))).otherwise(F.lit(None)).alias("h"),
        strip(F.when(x.rlike("^#"), F.regexp_replace(x, r"^#[^\n]*\n?", "")).otherwise(x)).alias("c"),
        k.alias("k"),
    )
    full = F.filter(F.transform("parts", lambda x, k: part(k, x)), lambda s: s["c"] != "")
    none = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit("(empty document)").alias("c"), F.lit(0).alias("k")))
    return base.select("p", "stem", F.explode(F.when(F.size(full) > 0, full).otherwise(none)).alias("s")).select(
        F.col("p").alias(path), F.col("s.k").alias("pos"), F.coalesce(F.nullif("s.h", F.lit("")), "stem").alias("heading"), F.col("s.c").alias("content")
    )


def digest_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of all markdown files below a folder, with the file as ``source``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return markdown_sections(files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")), "source", "text")


def journal_entries(rows: DataFrame, line: str = "line") -> DataFrame:
    """``ts`` and ``text`` of lines ``## <ts> <text>``; other lines are no entries."""
    hit = rows.where(F.col(line).rlike(r"^## \S+ "))
    return hit.select(F.regexp_extract(line, r"^## (\S+) (.*)$", 1).alias("ts"), F.regexp_extract(line, r"^## (\S+) (.*)$", 2).alias("text"))


def first_match(text: Column, patterns: list[str], least: int = 0) -> Column:
    """First group of the first pattern that finds more than ``least`` characters; null if none does."""
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*(F.when(F.length(F.trim(f)) > least, F.trim(f)) for f in found))


def decision_diagnosis(body: Column) -> Column:
    """Stated diagnosis of more than 20 characters, else the first line over 40 characters that is no heading, status or item; with a full stop."""
    starts, words = NO_DIAGNOSIS

    def says(x: Column) -> Column:
        out = F.length(x) > 40
        for w in starts:
            out = out & ~x.startswith(w)
        for w in words:
            out = out & ~x.contains(w)
        return out

    bare = lambda c: F.regexp_replace(c, r"\.+$", "")
    long = F.filter(F.transform(F.split(body, "\n"), strip), says)
    stated = [F.when(F.length(d) > 20, d) for d in (bare(strip(F.regexp_extract(body, p, 1))) for p in DIAGNOSES)]
    return F.concat(F.coalesce(*stated, bare(F.try_element_at(long, F.lit(1)))), F.lit("."))


def decision_cases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cases mined from decision logs: sections opened by ``## `` that speak of a failure and state a diagnosis."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"\n(?=## )"), lambda x: x.rlike("^## "))
    rows = docs.select(key, F.posexplode(parts).alias("pos", "s"))
    rows = rows.select(key, "pos", strip(F.regexp_extract("s", r"^## ([^\n]*)", 1)).alias("title"), F.regexp_replace("s", r"^## [^\n]*\n?", "").alias("body"))
    name = strip(F.regexp_replace(F.regexp_replace("title", r"\[.+\]", ""), r"^D-\d+\s*", ""))
    error = error_excerpt(F.col("body"))
    kept = rows.where(F.concat_ws(" ", "title", "body").rlike(FAILURE_WORDS)).withColumn("diagnosis", F.substring(decision_diagnosis(F.col("body")), 1, LONGEST)).where("diagnosis IS NOT NULL")
    return kept.select(
        key, "pos", canonical_signature(F.concat(name, F.lit(SEPARATOR), F.coalesce(error, F.lower(name)))).alias("signature"), F.substring(F.coalesce(error, "title"), 1, LONGEST).alias("error_excerpt"), "diagnosis"
    )


def error_excerpt(body: Column) -> Column:
    """What the first pattern of error lines that occurs finds; null if none does."""
    return F.coalesce(*(F.when(body.rlike(p), strip(F.regexp_extract(body, p, 1))) for p in ERROR_LINES))


def commit_cases(rows: DataFrame, line: str = "line") -> DataFrame:
    """Cases mined from lines ``<hash> <subject>`` whose subject fixes something and says what."""
    part = lambda k: F.regexp_extract(line, r"^([0-9a-f]{7,40})\s+(.+)$", k)
    fixes = rows.select(part(1).alias("commit"), strip(part(2)).alias("subject")).where(F.col("subject").rlike(FIX_SUBJECT))
    named = fixes.withColumn("_n", strip(F.regexp_replace("subject", FIX_SUBJECT, ""))).where("_n <> ''")
    signature = canonical_signature(F.concat("_n", F.lit(f"{SEPARATOR}fixed in "), "commit"))
    return named.select("commit", signature.alias("signature"), F.col("subject").alias("error_excerpt"), F.concat(F.lit("Fixed in commit "), "commit", F.lit(": "), "subject").alias("diagnosis"))


def transcript_cases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cases mined from transcripts: every line that starts with FAIL or ERROR, with the first test name in the preceding 500
    characters, else ``unknown_test``. Inside the row; of the lines before, no more are joined than 500 characters can hold."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n")
    rows = docs.select(key, lines.alias("ls")).select(key, F.posexplode("ls").alias("pos", "line"), "ls").where(F.col("line").rlike(r"(?i)^(?:FAIL|ERROR)[:\s]+\S"))
    near = F.slice("ls", F.greatest(F.col("pos") - 500, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(500)))
    before = F.substring(F.concat(F.array_join(near, "\n"), F.lit("\n")), -500, 500)
    name = F.coalesce(*(F.nullif(F.regexp_extract(before, TEST_NAME, k), F.lit("")) for k in (1, 2)), F.lit("unknown_test"))
    message = strip(F.regexp_extract("line", r"(?i)^(?:FAIL|ERROR)[:\s]+(.+)$", 1))
    signature = canonical_signature(F.concat(strip(name), F.lit(SEPARATOR), message))
    return rows.select(key, "pos", signature.alias("signature"), F.substring(message, 1, LONGEST).alias("error_excerpt"), F.lit(PENDING).alias("diagnosis"))


def mined(sources: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Cases of several archives (``signature``, ``error_excerpt``, ``diagnosis`` and the columns of ``order``), the first of every
    signature: sources in the order given, then ``order``. ``source`` says where it comes from."""
    rows = None
    for k, (name, df) in enumerate(sources.items()):
        part = df.select(F.lit(k).alias("_s"), F.lit(name).alias("source"), *(F.col(c).cast("string").alias(f"_o{j}") for j, c in enumerate(order)), "signature", "error_excerpt", "diagnosis")
        rows = part if rows is None else rows.unionByName(part)
    best = F.min_by(F.struct("source", "error_excerpt", "diagnosis"), F.struct("_s", *(f"_o{j}" for j in range(len(order)))))
    return rows.groupBy("signature").agg(best.alias("b")).select("signature", "b.*")


def exported(cases: DataFrame) -> DataFrame:
    """Mined cases as rows of a case base that nobody has numbered yet."""
    fixed = {n: F.lit(v) for n, v in MINED.items()}
    return cases.select(fixed["id"].cast("bigint").alias("id"), "signature", "error_excerpt", "diagnosis", fixed["times_seen"].cast("bigint").alias("times_seen"), fixed["last_seen"].alias("last_seen"), fixed["confirmed_by"].alias("confirmed_by"))


def first_by_signature(df: DataFrame, order: list[str]) -> DataFrame:
    """First row of every signature in the order given (all of ``order`` together must be unique)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("signature").orderBy(*order))).where("_k = 1").drop("_k")


def numbered_log(rows: DataFrame, line: str = "line") -> DataFrame:
    """Lines of five fields parted by the unit separator: commit, author, date, subject, refs; others are dropped."""
    f = F.split(line, "\x1f")
    return rows.select(f.alias("f")).where(F.size("f") == 5).select(*(F.get("f", k).alias(n) for k, n in enumerate(("commit", "author", "date", "subject", "refs"))))


def porcelain_status(rows: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a short status listing: ``index``, ``tree``, ``path``, ``origin`` (of a rename, else null); C-quoted paths lose their quotes."""
    plain = lambda c: F.regexp_replace(c, r'^"|"$', "")
    body = F.substring(line, 4, 4096)
    moved = F.split(body, " -> ")
    entry = rows.where(~F.col(line).startswith("##") & (F.length(line) > 3))
    return entry.select(
        F.substring(line, 1, 1).alias("index"), F.substring(line, 2, 1).alias("tree"), plain(F.element_at(moved, -1)).alias("path"), F.when(F.size(moved) == 2, plain(moved[0])).alias("origin")
    )


def branch_header(rows: DataFrame, line: str = "line") -> DataFrame:
    """Branch line of a short status listing: ``branch``, ``detached``, ``ahead``, ``behind``."""
    head = rows.where(F.col(line).startswith("## "))
    count = lambda w: F.coalesce(F.nullif(F.regexp_extract(line, rf"{w} (\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    name = F.regexp_extract(line, r"^## (?:No commits yet on )?(.+?)(?:\.\.\.\S+)?(?: \[.*\])?$", 1)
    return head.select(name.alias("branch"), F.col(line).contains("HEAD (no branch)").alias("detached"), count("ahead").alias("ahead"), count("behind").alias("behind"))


def grep_lines(docs: DataFrame, key: str, text: str, needle: str, ignore_case: bool = True, limit: int = 100, width: int = 200) -> DataFrame:
    """First ``limit`` lines by key and position that hold a literal text, cut to ``width`` characters (a report)."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n")).alias("_k", "_l"))
    hay, what = (F.lower("_l"), needle.lower()) if ignore_case else (F.col("_l"), needle)
    hit = rows.where(hay.contains(what)).select(key, (F.col("_k") + 1).alias("line_no"), F.substring("_l", 1, width).alias("line"))
    return hit.orderBy(key, "line_no").limit(limit)


def line_window(docs: DataFrame, key: str, text: str, start: int, count: int) -> DataFrame:
    """Lines ``start`` to ``start + count - 1`` (from 1) of every text."""
    rows = docs.select(key, F.posexplode(F.slice(F.split(F.col(text), r"\r\n|\n"), start, count)).alias("_k", "_l"))
    return rows.select(key, (F.col("_k") + start).alias("line_no"), F.col("_l").alias("line"))


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path``, ``size``, ``sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
