"""Stuffed pages and pages that only look so; the automaton against brute force."""

import random

import pytest

from casewright.llm.stuffing import SuffixAutomaton, stuffed_pages, stuffed_share

PROSE = "The reviewer asked for a smaller patch, and agent-e split src/a/parser.py in two. That explanation doesn't cover the failures seen on linux, so we'll look once more. "
LOG = "\n".join(f"2031-03-{k:02d}T10:00:00Z INFO a_vault heartbeat ok" for k in range(1, 28))
SPAM = [
    "test runner ci dashboard test runner test runner ci dashboard " * 12, "\n".join(f"- https://h{k}.example/a/b{k}" for k in range(30)), " ".join(f"#{a}{b}" for a in ("buy", "best", "top", "free") for b in ("TestRunner", "CiDashboard", "LogViewer")),
    "\n".join(f"SKU-{1000 + 37 * k} | Name{k} test runner | deals | ${k}.99 | add to cart" for k in range(25)), ", ".join(f"build cache in City{k}" for k in range(40)), "ERROR TRACKER / TEST RUNNER / " * 20,
    PROSE + "\n" + "\n".join(f"[best log viewer](https://h{k}.example/x)" for k in range(40)),
]
SOUND = [
    PROSE * 3, LOG, PROSE * 2 + "\nFurther reading:\n- https://a.example/b\n- https://c.example/d", "# Postmortem\n\n| option | default | meaning |\n| --- | --- | --- |\n" + "\n".join(f"| a.b{k} | {k} | how many lines load_{k} may hold |" for k in range(9)),
    "\n".join(f"{k}. Call load_{k} and wait {k}00 ms." for k in range(1, 15)), "user: Fix it\ntool: exit 1, 3 rows\n" * 15, "```\n" + "x = call(1)\n" * 40 + "```", "Dump of a:\n" + "\n".join("AbC9" * 16 + str(k) for k in range(20)), "", "   ", "原因在于 a.limit，load_b 读取这个值的时间太早。" * 6,
]

LISTS = [
    "\n".join(f"https://h{k}.example/a/b{k}" for k in range(30)), "\n".join(f"  http://h{k}.example:8080/a?b={k}" for k in range(30)), "\n".join(f"www.h{k}.example/a" for k in range(30)), "\n".join(f"from https://h{k}.example/a?b={k}" for k in range(30)),
    "\n".join(f"link: https://h{k}.example/a" for k in range(30)), "\n".join(f"SKU: {k}\nprice: ${k}" for k in range(30)), PROSE + "\n" + "\n".join(f"https://h{k}.example/a/b{k}" for k in range(20)),
]
STRUCTURED = [
    "\n".join(f"2031-03-{k:02d}T10:00:00Z INFO GET https://h{k}.example/a/b" for k in range(1, 28)), "\n".join(f"a.b{k}: {k}" for k in range(30)), "\n".join(f"curl https://h{k}.example/a" for k in range(30)),
    "\n".join(f"from a.b{k} import c{k} (d)" for k in range(30)), "\n".join(f"for k in range({k}):" for k in range(30)), PROSE * 2 + "\nhttps://a.example/b\nhttps://c.example/d",
]


CHINESE = "便宜手机，优惠手机，手机商城，手机促销，" * 40, "便宜手机。优惠手机。手机商城。手机促销。" * 40, "便宜手机 优惠手机 手机商城 手机促销 " * 40
CHINESE_PROSE = "原因在于缓存没有在重启之后清空，所以第二次运行读到了旧的值。我们把读取移到启动之后，并且加了测试。" * 3, "审查者要求补丁更小，因此我把解析器分成了两个文件，而测试也都通过了。" * 12


@pytest.mark.parametrize("text", CHINESE)
def test_chinese_keywords(text):
    assert stuffed_share(text) > 0.5


@pytest.mark.parametrize("text", CHINESE_PROSE)
def test_chinese_prose(text):
    assert stuffed_share(text) <= 0.5


@pytest.mark.parametrize("length", [2, 5, 30])
def test_the_length_of_lines_decides_nothing(length):
    """The same sentences in lines of any number of them have the same share."""
    parts = ["Buy cheap runners now.", "Best ci dashboard.", "The build that we ran yesterday is green."] * 30
    assert stuffed_share("\n".join(" ".join(parts[k : k + length]) for k in range(0, 90, length))) == pytest.approx(stuffed_share("\n".join(parts)), abs=0.02)


@pytest.mark.parametrize("text", LISTS)
def test_bare_lists(text):
    assert stuffed_share(text) > 0.5


@pytest.mark.parametrize("text", STRUCTURED)
def test_structured_lines(text):
    assert stuffed_share(text) <= 0.5


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert stuffed_share(text) > 0.5


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert stuffed_share(text) <= 0.5


def test_share_below_one_half(spark):
    """A page of a third of stuffing is found from a fifth on, with the share that it has; one of prose never is."""
    page = PROSE * 4 + "\n" + "test runner ci dashboard " * 14
    df = spark.createDataFrame([(1, page), (2, PROSE * 3), (3, SPAM[0])], "doc_id long, text string")
    got = {s: {r["doc_id"]: r["stuffed_share"] for r in stuffed_pages(df, "doc_id", "text", s).collect()} for s in (0.2, 0.5, 0.9)}
    assert [sorted(g) for g in got.values()] == [[1, 3], [3], [3]] and 0.2 < got[0.2][1] < 0.5


def test_automaton_matches_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        got = SuffixAutomaton(s).repeats(3)
        want = []
        for k in range(len(s)):
            best = 0
            for n in range(1, k + 2):
                part = s[k - n + 1 : k + 1]
                if sum(s[i : i + n] == part for i in range(len(s) - n + 1)) >= 3:
                    best = n
            want.append(best)
        assert got == want


def test_column(spark):
    rows = [(1, SPAM[0], 0.1), (1, SPAM[0], 0.1), (2, None, 0.1), (3, "", 0.1), (None, SPAM[1], 0.1), (4, PROSE * 3000, 0.1), (5, SPAM[0] * 300, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stuffed_share double")
    assert sorted((r["doc_id"] or 0) for r in stuffed_pages(df, "doc_id", "text").collect()) == [0, 1, 1, 5]
    assert stuffed_pages(df.limit(0), "doc_id", "text").count() == 0
