"""Checks and gates on small frames; PNG round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import checks as C
from casewright.plans import pipelines as P
from casewright.sources.images import image_facts, png_pixels


def test_steps_skip_after_failure(spark):
    rows = [(1, 1, 0, 0, "ok fine", "fine", None, False), (1, 2, 1, 0, "", None, None, True), (1, 3, 0, None, "bad", None, "bad", False), (1, 4, 0, 0, "x", None, None, False)]
    df = spark.createDataFrame(rows, "k int, pos int, exit_code int, want_exit int, output string, must_contain string, must_not_contain string, optional boolean")
    assert [r["ok"] for r in C.verified_steps(df, "k", "pos").orderBy("pos").collect()] == [True, False, False, None]


def test_requirements(spark):
    r = spark.createDataFrame([("a", "1.10"), ("b", "2.0"), ("c", "1"), ("d", "1.0"), ("e", "1.0")], "name string, version string")
    f = spark.createDataFrame([("a", "1.9.3"), ("b", "2"), ("c", "none"), ("e", "v1.0.1-rc")], "name string, version string")
    assert {(x["name"], x["status"]) for x in C.requirements(r, f).collect()} == {("a", "mismatch"), ("b", "ok"), ("c", "mismatch"), ("d", "missing"), ("e", "ok")}


@pytest.mark.parametrize(
    ("url", "ok"),
    [("https://a.example/x", True), ("http://a.example:80/", True), ("https://a.example:8443/", False), ("ftp://a.example", False), ("http://localhost/", False), ("http://192.168.1.4/x", False), ("http://172.20.0.1", False), ("http://172.40.0.1", True), ("", False), (None, False)],
)
def test_urls(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(C.url_allowed(F.col("u"))).first()[0] is ok


def test_small_predicates(spark):
    df = spark.createDataFrame([("abc1234", "One timeout here. Other.\nTimeout again"), ("abc", None)], "q string, t string")
    got = df.select(C.is_hash_query(F.col("q")), C.relevant_sentences(F.col("t"), ["TIMEOUT"]), C.facts_missing(F.col("t"), F.array(F.lit("Other"), F.lit("none")))).collect()
    assert [tuple(g) for g in got] == [(True, ["One timeout here.", "Timeout again"], ["none"]), (False, None, ["Other", "none"])]
    r = spark.createDataFrame([(1, "Hello"), (2, "continue"), (3, "Fix the hello page"), (4, None)], "k int, goal string")
    assert {tuple(x) for x in C.hygiene(r, "goal", "k").collect()} == {(1, "greeting"), (2, "continuation"), (4, "greeting")}
    o = spark.createDataFrame([("s", 2, "second"), ("s", 1, " first\nline"), ("t", 1, "")], "k string, n int, t string")
    assert [tuple(x) for x in C.first_failure(o, "k", [F.col("n")], "t").collect()] == [("s", "first")]


def encode(pixels, colour, form):
    """A PNG of an array with one filter for all lines."""
    h, w, n = pixels.shape
    rows, out = pixels.reshape(h, w * n).astype(int), b""
    for y in range(h):
        line = []
        for x in range(w * n):
            a, b, c = (rows[y, x - n] if x >= n else 0), (rows[y - 1, x] if y else 0), (rows[y - 1, x - n] if y and x >= n else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((rows[y, x] - (0, a, b, (a + b) // 2, near)[form]) & 255)
        out += bytes([form, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("form", range(5))
@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (6, 4)])
def test_png(form, colour, n):
    rng = random.Random(form * 7 + n)
    pixels = np.array([[[rng.randint(0, 255) for _ in range(n)] for _ in range(7)] for _ in range(5)], np.uint8)
    got = png_pixels(encode(pixels, colour, form))
    assert (got == (np.repeat(pixels, 3, 2) if n == 1 else pixels[..., :3])).all()


def test_image_facts(spark):
    white = np.full((4, 4, 3), 255, np.uint8)
    dot = white.copy()
    dot[1, 1] = 0
    rows = [(1, encode(white, 2, 0), encode(dot, 2, 1)), (2, None, encode(white, 2, 2)), (3, b"x", b"y")]
    got = {r["k"]: (r["width"], r["changed"], r["blank_percent"]) for r in image_facts(spark.createDataFrame([(k, a and bytearray(a), b and bytearray(b)) for k, a, b in rows], "k int, a binary, b binary"), "k", "a", "b").collect()}
    assert got == {1: (4, 1, 93.75), 2: (4, None, 100.0), 3: (None, None, None)}


def test_advice_tiers(spark):
    cases = spark.createDataFrame([(1, "t :: keyerror: x", "old", 1), (2, "t :: keyerror: x", "new", 5), (3, "u :: oserror: y", "other", 1)], "id long, signature string, diagnosis string, times_seen long")
    f = spark.createDataFrame([("a", "T :: KeyError: x\nmore"), ("b", "OSError:  y"), ("c", "unknown"), ("d", None)], "k string, t string")
    assert {tuple(r) for r in P.advise(f, "k", "t", cases).collect()} == {("a", "signature", 2, "new"), ("b", "error", 3, "other"), ("c", "none", None, None), ("d", "none", None, None)}
