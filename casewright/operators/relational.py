"""Filters, joins, set operations and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import canonical_signature, parse_stamp, present


def latest_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key in a total order; null keys count as one key.

    An aggregate (``max_by``), so a hot key is combined before the shuffle and never gathered into one row.
    """
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def fold_flakes(flakes: DataFrame) -> DataFrame:
    """Passes of each signature: identical deliveries count once, the others add up; latest stamp."""
    once = flakes.dropDuplicates(["signature", "times_passed", "last_pass"]).where("signature IS NOT NULL")
    return once.groupBy("signature").agg(F.sum("times_passed").alias("times_passed"), F.max(parse_stamp(F.col("last_pass"))).alias("last_pass"))


def fold_cases(cases: DataFrame) -> DataFrame:
    """Cases of each signature: smallest id, occurrences added up, latest sighting."""
    return (
        cases.where("signature IS NOT NULL")
        .groupBy("signature")
        .agg(F.min("id").alias("id"), F.sum("times_seen").alias("times_seen"), F.max(parse_stamp(F.col("last_seen"))).alias("last_seen"), F.count("*").alias("records"))
    )


def stale(cases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Cases last seen strictly more than ``days`` before ``now``; a stamp without zone is UTC."""
    return cases.where(parse_stamp(F.col("last_seen")) < now - F.expr(f"INTERVAL {int(days)} DAYS"))


def pending(cases: DataFrame) -> DataFrame:
    """Cases nobody confirmed."""
    return cases.where("confirmed_by = 'unknown'")


def lookup(cases: DataFrame, signatures: DataFrame) -> DataFrame:
    """All cases with exactly a wanted signature, most seen first, and whether several share it.

    ``signatures`` has one column ``signature``; a left semi join in effect, the count an aggregate joined back.
    """
    hit = cases.join(signatures.distinct(), "signature", "left_semi")
    many = hit.groupBy("signature").agg((F.count("*") > 1).alias("ambiguous"))
    return hit.join(many, "signature").orderBy(F.desc("times_seen"), "id")


def flaky_rates(cases: DataFrame, flakes: DataFrame, chronic: float = 0.5) -> DataFrame:
    """Pass rate of every signature in both tables; chronic where it is above the threshold."""
    both = fold_cases(cases).join(fold_flakes(flakes), "signature")
    rate = F.col("times_passed") / (F.col("times_passed") + F.col("times_seen"))
    return both.withColumn("pass_rate", rate).withColumn("chronic", rate > chronic)


def regressions(cases: DataFrame, flakes: DataFrame, chronic: float = 0.5, least: int = 3) -> DataFrame:
    """First-time failures (never passed, seen once) and regressions (passed often, not chronic, failed after the last pass)."""
    both = fold_cases(cases).join(fold_flakes(flakes), "signature", "left")
    rate = F.col("times_passed") / (F.col("times_passed") + F.col("times_seen"))
    kind = F.when(F.col("times_passed").isNull() & (F.col("times_seen") == 1), "first-time").when(
        (rate <= chronic) & (F.col("times_passed") >= least) & (F.col("last_seen") > F.col("last_pass")), "regression"
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("signature", "id", "kind")


def recall(items: DataFrame, cases: DataFrame) -> DataFrame:
    """Items whose canonical signature meets exactly one case with the same diagnosis: ``hits``, ``total``, ``pct``."""
    want = items.select("signature", F.col("diagnosis").alias("_d"), canonical_signature(F.col("signature")).alias("_s"))
    per = cases.groupBy(F.col("signature").alias("_s")).agg(F.count("*").alias("n"), F.min("diagnosis").alias("_found"))
    hit = want.join(per, "_s", "left").select((F.coalesce("n", F.lit(0)) == 1).alias("one"), F.col("_found").eqNullSafe(F.col("_d")).alias("same"))
    good = hit.agg(F.count_if(F.col("one") & F.col("same")).alias("hits"), F.count("*").alias("total"))
    return good.withColumn("pct", F.round(100 * F.col("hits") / F.nullif("total", F.lit(0))).cast("bigint"))


def exclude(df: DataFrame, key: str, unwanted: DataFrame, other: str) -> DataFrame:
    """Rows whose key isn't among the unwanted ones (null keys stay)."""
    return df.join(unwanted.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def unrejected(candidates: DataFrame, rejected: DataFrame, kind: str = "type", members: str = "supporting_cases") -> DataFrame:
    """Candidates whose kind and members, in whatever order, weren't rejected."""
    key = lambda d: d.withColumn("_m", F.array_sort(members))
    return key(candidates).join(key(rejected).select(kind, "_m").distinct(), [kind, "_m"], "left_anti").drop("_m")


def full_diff(before: DataFrame, after: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """Status of every key of two listings, first fault first: missing, size drift, hash drift, unlisted, or same."""
    a, b = (d.select(key, F.col(size).alias(f"_{n}s"), F.col(digest).alias(f"_{n}h"), F.lit(True).alias(f"_{n}")) for n, d in (("a", before), ("b", after)))
    status = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(~F.col("_as").eqNullSafe(F.col("_bs")), "size drift").when(~F.col("_ah").eqNullSafe(F.col("_bh")), "hash drift").otherwise("same")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def changed(ledger: DataFrame, scan: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that are new or differ from the ledger, and those that left: ``change`` is changed, new or removed."""
    a, b = ledger.select(key, F.col(digest).alias("_a")), scan.select(key, F.col(digest).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")


def rule_matches(texts: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Every rule ``(id, pattern)`` that matches a text, and whether several do.

    One projection over all rules (a rule pack is a bounded list), no join; the text itself isn't copied for each rule.
    """
    hit = F.filter(F.array(*(F.when(F.col(text).rlike(p), F.lit(i)) for i, p in rules)), lambda x: x.isNotNull())
    rows = texts.select(key, hit.alias("_h")).where(F.size("_h") > 0)
    return rows.select(key, F.explode("_h").alias("rule"), (F.size("_h") > 1).alias("ambiguous"))


def keyword_any(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows that hold any of the words in any of the columns, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return df.where(F.reduce(F.array(*(hay.contains(w.lower()) for w in words)), F.lit(False), lambda a, x: a | x))


def keyword_density(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows with at least one of the words and ``score``, the share of the words that they hold."""
    hay = F.lower(F.concat_ws(" ", *columns))
    score = sum((hay.contains(w.lower()).cast("int") for w in words), F.lit(0)) / len(words)
    return df.withColumn("score", score).where("score > 0")


def similar(df: DataFrame, text: str, query: str, times: str, confidence: str, least: int = 3) -> DataFrame:
    """``score`` of records for a query: 2 for each shared word, half of the sightings up to 5, and the confidence; records without a shared word are left out."""
    terms = [w for w in dict.fromkeys(query.lower().replace("_", " ").split()) if len(w) >= least]
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    overlap = F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    score = 2 * overlap + 0.5 * F.least(F.col(times), F.lit(5)) + F.coalesce(confidence, F.lit(0.0))
    scored = df.withColumn("overlap", overlap).withColumn("score", score)
    return scored.where("overlap > 0") if terms else scored


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of a total order (a report)."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key in a total order with their rank; Spark keeps ``n`` rows a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def zip_positions(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of two ordered lists of the same key side by side, as far as both go."""
    return left.join(right, [key, pos])


def previous_where(df: DataFrame, key: str, order: list[Column], wanted: Column, value: Column, name: str) -> DataFrame:
    """The nearest earlier ``value`` of the same key among rows that are ``wanted`` (an as-of join by window)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(wanted, value), ignorenulls=True).over(w))


def disagreeing_pairs(df: DataFrame, group: str, who: str, what: str) -> DataFrame:
    """Pairs of participants of a group whose proposals differ.

    Not all pairs of rows: proposals are counted by value first, and only values are paired, so a group of many who
    agree costs one row; ``pairs`` is the number of pairs of participants behind a pair of values.
    """
    each = df.groupBy(group, what).agg(F.count_distinct(who).alias("n"))
    a, b = each.alias("a"), each.alias("b")
    return a.join(b, group).where(F.col(f"a.{what}") < F.col(f"b.{what}")).select(group, F.col(f"a.{what}").alias("one"), F.col(f"b.{what}").alias("other"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


def covered(columns: list[str]) -> Column:
    """Whether all columns hold something."""
    out = F.lit(True)
    for c in columns:
        out = out & present(F.col(c))
    return out
