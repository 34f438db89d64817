"""Records that differ only in formatting: whitespace, case, punctuation, order of named fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.plans.session import stored

# A name as it stands before its value: quotes of any kind, then the sign that parts it from the value. A name in double
# or single quotes goes up to the closing one, whatever it holds.
_QUOTE = "[\"'`‘’“”]*"
_BLANK = r"[\s\p{Z}\p{Cf}]"  # white space of any kind, and what has no width
_SIGN = rf"{_BLANK}*(?:=>|->|:=|=|:)"
_QUOTED = "(?:" + "|".join(rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in "\"'") + ")"
_NAME = rf"(?:{_QUOTED}{_SIGN}|{_QUOTE}[\p{{L}}_][\p{{L}}\p{{N}}_.\-]*{_QUOTE}{_SIGN})"
_EDGE = rf"^(?:[^\p{{L}}\p{{N}}\"']*(?={_QUOTED}{_SIGN})|[^\p{{L}}\p{{N}}]+)"
_NAMED = rf"^{_NAME}"
_BREAK = rf"(?:{_BLANK}|[,;|&])+(?={_NAME})"


def bare(text: Column) -> Column:
    """Letters and digits only, letter case folded, with sharp s as double s and final sigma as sigma."""
    return F.replace(F.translate(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def field_list(text: Column) -> Column:
    """The sorted ``name value`` pairs of a text that is nothing but a list of at least two named fields, else null.

    ``{"a": 1, "b": 2}``, ``a=1; b=2`` and ``a: 1`` by lines are lists; neither order nor notation count. Log lines
    that look like one (``FAIL: ... KeyError: ...``) may pass as lists; see ``collapse_formatting``.
    """
    body = F.regexp_replace(text, _EDGE, "")
    # a quote of another kind that opened the first name has gone with the edge; the closing one is still part of _NAME
    pair = lambda p: F.concat(
        bare(F.regexp_extract(p, rf"^({_NAME})", 1)), F.lit("\u0002"), bare(F.regexp_replace(p, rf"^{_NAME}", ""))
    )
    listed = F.array_join(F.array_sort(F.transform(F.split(body, _BREAK), pair)), "\u0001")
    return F.when(body.rlike(_NAMED) & body.rlike(_BREAK), listed)


def _digest(*columns: str) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def collapse_formatting(df: DataFrame, id_col: str, plain: list[str], listed: list[str], single: bool = True) -> tuple[DataFrame, DataFrame]:
    """Groups of records that agree in ``plain`` and ``listed`` columns up to formatting.

    Returns ``(groups, members)``: groups has ``first_id``, ``copies`` (rows, exact repeats included) and ``spellings``
    (distinct raw forms), one row for each distinct record; members has ``first_id`` and ``id`` of every row, or,
    without ``single``, of those in groups of two rows or more.

    Two fields agree when their letters and digits do, whatever the case; two ``listed`` fields also when both are
    lists of the same named fields. The steps: byte-identical rows are counted first, combined before the shuffle, so
    a form that holds a third of all rows is one row afterwards; only distinct forms are canonicalised, once, into a
    table in the shared folder, and their counts summed over the full canonical text; what is left is grouped once more
    by its field lists, by digests of them. (The list of a group is that of any of its spellings, so a spelling whose
    signs between name and value are lost stays in.) Ids come back by joins on 128-bit digests, sorted ones, as all sides
    grow with the table; their large side may be hot and is split by adaptive execution. The texts of ``df`` are read once
    for the groups and once for the members.

    Nulls: a null field equals a null field and nothing else; rows with a null id count as copies but are no members.
    A text of punctuation only equals an empty one. An empty table gives two empty results. Other columns of ``df``
    are not read, so their names can't clash.
    """
    fields = [*plain, *listed]
    raw = df.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_f{k}") for k, c in enumerate(fields)))
    names = [f"_f{k}" for k in range(len(fields))]
    texts, lists = [f"_c{k}" for k in range(len(fields))], [f"_l{k}" for k in range(len(plain), len(fields))]
    once = raw.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_id").alias("_min"))
    forms = stored(
        once.select(
            _digest(*names).alias("_raw"),
            "_n",
            "_min",
            *(bare(F.col(f)).alias(c) for f, c in zip(names, texts)),
            *(field_list(F.col(f"_f{x[2:]}")).alias(x) for x in lists),
        )
    )
    equal = forms.groupBy(*texts).agg(
        F.sum("_n").alias("_n"), F.min("_min").alias("_min"), F.count("*").alias("_s"), *(F.min(x).alias(x) for x in lists)
    )
    # a list replaces the text that it was made of; \u0003 keeps lists and texts apart
    whole = [F.coalesce(F.concat(F.lit("\u0003"), F.col(f"_l{c[2:]}")), F.col(c)) if f"_l{c[2:]}" in lists else F.col(c) for c in texts]
    equal = equal.select("_n", "_min", "_s", _digest(*texts).alias("_text"), F.struct(*(w.alias(c) for w, c in zip(whole, texts))).alias("_w"))
    equal = stored(equal.select("_n", "_min", "_s", "_text", F.unhex(F.md5(F.to_json("_w"))).alias("_whole")))
    grouped = equal.groupBy("_whole").agg(F.sum("_n").alias("copies"), F.min("_min").alias("first_id"), F.sum("_s").alias("spellings"))
    first = grouped.where(F.lit(single) | (F.col("copies") > 1)).select("_whole", "first_id")
    placed = equal.select("_text", "_whole").join(first.hint("merge"), "_whole").select("_text", "first_id")
    placed = forms.select("_raw", _digest(*texts).alias("_text")).join(placed.hint("merge"), "_text").select("_raw", "first_id")
    members = raw.where("_id IS NOT NULL").select("_id", _digest(*names).alias("_raw")).join(placed.hint("merge"), "_raw")
    return grouped.select("first_id", "copies", "spellings"), members.select("first_id", F.col("_id").alias("id"))
