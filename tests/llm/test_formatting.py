"""Formatting duplicates against brute force on small records."""

import itertools
import json
import re

from casewright.llm.formatting import collapse_formatting

SCHEMA = "id long, signature string, error_excerpt string, first_id long, copies long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)
    groups, members = collapse_formatting(df, "id", ["signature"], ["error_excerpt"])
    return {tuple(r) for r in groups.collect()}, {r["id"]: r["first_id"] for r in members.collect()}


def key(sig, text):
    """Brute force: letters and digits; lists of named fields as sorted pairs."""
    bare = lambda s: None if s is None else re.sub(r"[\W_]+", "", s).upper().lower()
    fields = None
    try:
        fields = json.loads(text)
    except (TypeError, ValueError):
        if text and re.fullmatch(r"\w+=[^;=]*(?:; \w+=[^;=]*)+", text):
            fields = dict(p.split("=") for p in text.split("; "))
        elif text and re.fullmatch(r"\w+: [^\n:]*(?:\n\w+: [^\n:]*)+", text):
            fields = dict(p.split(": ") for p in text.split("\n"))
    if isinstance(fields, dict) and len(fields) > 1:
        return bare(sig), tuple(sorted((bare(k), bare(str(v))) for k, v in fields.items()))
    return bare(sig), bare(text)


def test_matches_brute_force(spark):
    texts = [
        "Ran 5 tests, KeyError in load: bad 'x'", "RAN 5 TESTS KEYERROR IN LOAD BAD X", "ran 5 tests; KeyError in load: bad 'y'", None, "", "...", "Straße 1", "STRASSE 1",
        '{"a": 1, "b": "two words", "c_d": "x"}', "b=two words; c_d=x; a=1", "c_d: X\na: 1\nb: TWO WORDS", '{"a": 2, "b": "two words", "c_d": "x"}', "a=1; b=two words; c_d=y",
    ]
    rows = [(k, s, t) for k, (s, t) in enumerate(itertools.product(["T :: e", "t::E", "u :: e"], texts), 1)]
    groups, members = run(spark, rows)
    want = {}
    for k, s, t in rows:
        want.setdefault(key(s, t), []).append(k)
    assert members == {k: min(v) for v in want.values() for k in v}
    assert {(g[0], g[1]) for g in groups} == {(min(v), len(v)) for v in want.values()}


def test_log_lines_keep_their_spellings_together(spark):
    one = "FAIL: load (worker 1)\nKeyError: missing x, expected 4 got 7"
    two = "fail - load (worker 1)\nkeyerror - missing x expected 4 got 7"
    swapped = "FAIL: load (worker 1)\nKeyError: missing x, expected 7 got 4"
    _, members = run(spark, [(1, "s", one), (2, "s", two), (3, "s", swapped)])
    assert members == {1: 1, 2: 1, 3: 3}


def test_blanks_of_any_kind_around_signs(spark):
    nb = "\u00a0"
    _, members = run(spark, [(1, "s", "a=1; b_c=two words"), (2, "s", f'b_c{nb}={nb}"two{nb}words"{nb}|{nb}a{nb}={nb}"1"'), (3, "s", "\ufeffB_C: Two Words\r\nA: 1 ...")])
    assert members == {1: 1, 2: 1, 3: 1}


def test_quoted_names_of_any_characters(spark):
    """Order and notation don't count for names with blanks, digits first, marks or escapes; values still do."""
    fields = {"exit code": 1, "2xx": 7, "@timestamp": "two words", 'a "b" c': "x", "plain": "y: z"}
    texts = [json.dumps(dict(p)) for p in itertools.permutations(fields.items())]
    _, members = run(spark, [(k, "s", t) for k, t in enumerate([*texts, str(fields), json.dumps(fields, indent=1), json.dumps(fields | {"2xx": 8}), json.dumps(fields | {"exit code": 7, "2xx": 1})])])
    n = len(texts)
    assert members == {**{k: 0 for k in range(n + 2)}, n + 2: n + 2, n + 3: n + 3}


def test_counts_sum_over_exact_and_other_spellings(spark):
    groups, members = run(spark, [(k, "hot", "same text") for k in range(200)] + [(300, "HOT", "Same-Text!")])
    assert groups == {(0, 201, 2)} and len(members) == 201


def test_nulls_long_texts_and_empty_tables(spark):
    long = "word " * 200_000
    _, members = run(spark, [(1, None, None), (2, None, None), (3, "", None), (4, "s", long), (5, "S", long.upper()), (None, "s", long)])
    assert members == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert run(spark, []) == (set(), {})
