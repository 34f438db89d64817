"""Near-duplicate classes against brute force; losslessness of the pivot table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import neardup

SCHEMA = "experience_id string, text string, rep string, s string, links long"


def brute(rows, n, threshold):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            if s := frozenset(zip(*(w[j:] for j in range(n)))):
                sets[k] = s
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    members = {}
    for k in keys:
        members.setdefault(find(k), []).append(k)
    return {k: min(v) for v in members.values() if len(v) > 1 for k in v}


def run(spark, rows, n=3, threshold=0.5):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    out = neardup.near_duplicates(df, "experience_id", F.col("text"), n, threshold)
    return {r["experience_id"]: r["first_id"] for r in out.collect()}


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.5), (5, 0.8), (1, 1.0)])
def test_matches_brute_force(spark, n, threshold):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        for m in range(rng.randint(1, 6)):
            text = base[:]
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((f"{g:02d}-{m}", " ".join(text)))
    assert run(spark, rows, n, threshold) == brute(rows, n, threshold)


def test_chain_of_a_hot_class(spark):
    """Many texts that each resemble their neighbours only are one class."""
    words = [f"v{k}" for k in range(140)]
    rows = [(f"{k:03d}", " ".join(words[k : k + 40])) for k in range(100)]
    assert run(spark, rows) == brute(rows, 3, 0.5) == {k: "000" for k, _ in rows}


def test_nulls_short_texts_copies_and_empty_tables(spark):
    long = " ".join(f"z{k}" for k in range(60_000))
    rows = [("a", "one two three four"), ("b", "One, two; THREE four"), ("c", None), (None, "one two three four"), ("d", "one two"), ("e", "one two"), ("f", ""), ("g", long), ("h", long + " end"), ("a", "one two three four")]
    assert run(spark, rows) == {"a": "a", "b": "a", "g": "g", "h": "g"}
    assert run(spark, []) == {}


def test_fingerprints_never_exceed_the_symmetric_difference():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**62), 2**62, 90), rng.integers(-(2**62), 2**62, 40)
    x, y = np.concatenate([a, b[:10]]), np.concatenate([a[5:], b])
    bits = neardup.odd_sketches(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y]))
    pivots = neardup.choose_pivots(bits)
    gap = len(set(x.tolist()) ^ set(y.tolist()))
    assert (bits[0] != bits[1]).sum() <= gap
    assert np.abs((bits[0] != pivots).sum(1).astype(int) - (bits[1] != pivots).sum(1).astype(int)).max() <= gap


def counted(monkeypatch):
    """The numbers of pairs that were verified, one after the other."""
    made, verify = [], neardup._verify

    def run_(pairs, table, threshold):
        made.append(pairs.count())
        return verify(pairs, table, threshold)

    monkeypatch.setattr(neardup, "_verify", run_)
    return made


def texts(sets):
    return [(f"{k:05d}", " ".join(sorted(s))) for k, s in enumerate(sets)]


def result(spark, rows, crowd, threshold):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return {r["experience_id"]: r["first_id"] for r in neardup.near_duplicates(df, "experience_id", F.col("text"), 1, threshold, crowd).collect()}


def test_a_posting_of_many_unlinked_records_costs_no_pairs(spark, monkeypatch):
    """5,000 records share one shingle of their prefixes and else only a few with others."""
    rng = random.Random(5)
    often = [f"o{k}" for k in range(300)]
    sets = [{"shared", f"u{k}", *rng.sample(often, 6)} for k in range(5000)]
    made = counted(monkeypatch)
    out = result(spark, texts(sets), 64, 0.5)
    assert sum(made) < 60 * len(sets)  # all pairs: 12,497,500
    few = texts(sets)[:600]
    assert result(spark, few, 8, 0.5) == brute(few, 1, 0.5) and out.keys() >= brute(few, 1, 0.5).keys()


def test_two_large_classes_in_one_posting(spark, monkeypatch):
    rng = random.Random(6)
    bases = [[f"{side}{k}" for k in range(30)] for side in "ab"]
    sets = [{"shared", *rng.sample(bases[k % 2], 24)} for k in range(6000)]
    made = counted(monkeypatch)
    out = result(spark, texts(sets), 64, 0.6)
    assert sum(made) < 60 * len(sets)  # of each member with each of the other class: 9,000,000
    assert set(out.values()) == {"00000", "00001"} and len(out) == len(sets)


@pytest.mark.parametrize(("threshold", "levels"), [(0.3, 4), (0.5, 1), (0.5, 2), (0.8, 3)])
def test_crowded_postings_lose_no_link(spark, monkeypatch, threshold, levels):
    """Small sets of few words: every posting is crowded, sets that need to share one shingle only among them."""
    monkeypatch.setattr(neardup, "LEVELS", levels)
    rng = random.Random(levels)
    words = [f"w{k}" for k in range(25)]
    rows = texts({frozenset(rng.sample(words, rng.randint(1, 9))) for _ in range(200)})
    assert result(spark, rows, 3, threshold) == brute(rows, 1, threshold)
