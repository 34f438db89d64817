"""Leaked passages against brute force."""

import random
import re

import pytest

from casewright.llm import leakage


def brute(docs, items, run):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    wins = lambda w: {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    return {(d, i) for d, t in docs if d is not None and t for i, u in items if i is not None and u and wins(words(t)) & wins(words(u))}


def go(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, diagnosis string, text string")
    return {tuple(r) for r in leakage.leaked_items(d, "doc_id", "text", i, "item_id", "diagnosis", **how).collect()}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefg") + rng.choice("hij") for _ in range(n))
    items = [(k, text(30)) for k in range(12)]
    docs = []
    for k in range(40):
        i = items[k % 12][1].split()
        cut = rng.randint(5, 18)
        at = rng.randint(0, 30 - cut)
        docs.append((k, text(20) + "\n" + ", ".join(i[at : at + cut]).upper() + ".\n" + text(10)))
    assert go(spark, docs, items) == brute(docs, items, 12)
    assert go(spark, docs, items, run=4, shingle=2) == brute(docs, items, 4)


def test_nulls_short_repeated_long_and_empty(spark):
    words = " ".join(f"w{k}" for k in range(12))
    long = "filler text " * 100_000 + words
    docs = [(1, words), (1, words), (2, None), (3, ""), (None, words), (4, long), (5, "w0 w1 w2")]
    items = [(7, words), (7, words), (8, None), (9, "w0 w1"), (None, words)]
    assert go(spark, docs, items) == {(1, 7), (4, 7)}
    assert go(spark, [], items) == go(spark, docs, []) == set()
    with pytest.raises(ValueError):
        go(spark, docs, items, run=2, shingle=3)
