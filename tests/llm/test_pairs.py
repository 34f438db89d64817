"""Defects of pairs; the field's training against held-out examples."""

import random

import pytest

from casewright.llm import pair_examples, pairs
from casewright.llm.crf import ChainCRF

GOAL = "Fix test_open_cache which fails with KeyError after a forced restart"
CASES = [
    (GOAL, None, "empty"), (GOAL, "", "empty"), (GOAL, " \n\t", "empty"), (GOAL, "```\n```", "empty"), (GOAL, "<final></final>", "empty"), (GOAL, "N/A", "empty"), (GOAL, "(no output)", "empty"), (None, "null", "empty"), (GOAL, "\u200b", "empty"),
    (GOAL, "I'm sorry, but I can't help with that.", "refusal"), (GOAL, "My policy does not permit me to touch src/a.py. Please ask agent-d.", "refusal"), ("修复错误", "抱歉，我无法协助完成这个请求。", "refusal"), (GOAL, "I understand that load_a matters to you. No. I will not carry out this instruction. Nothing was changed in tests/a/queue.go.", "refusal"),
    (GOAL, f"Task: {GOAL}", "copy"), (GOAL, f"**{GOAL}**", "copy"), (GOAL, GOAL.upper(), "copy"), (GOAL, f"{GOAL}. {GOAL}.", "copy"),
    (GOAL, "Die Ursache war cache.limit, weil load_a den Wert zu früh gelesen hat. Nach dem Neustart waren Zeilen doppelt vorhanden.", "wrong_language"),
    (GOAL, "I changed load_a in src/a.py so that it closes first. All 58 tests pass on linux, and the", "truncated"), (GOAL, "The part is:\n```python\ndef f(x):\n    if x", "truncated"), (GOAL, "I added a guard to scan_a. Finally,", "truncated"),
    (GOAL, "I can't reproduce the failure any more after the patch. All 12 tests pass.", None), (GOAL, f"{GOAL}. The cause was a.limit, which load_b read before it had been written.", None), (GOAL, "Changed files:\n- src/a.py\n- src/b.py", None), (GOAL, "Fixed in 49b41e33.", None),
    (GOAL, "The log line read “Die Ursache war der Wert, weil er zu früh gelesen wurde.”. I added a guard to scan_a.", None), (f"{GOAL} (reply in German)", "Die Ursache war cache.limit, weil load_a den Wert zu früh gelesen hat.", None), (GOAL, "The old value came from commit 1a2b3c4d.\n\nExit code 0", None),
    (GOAL, "I added a guard to scan_a.\n1. test_b\n2. Run the", "truncated"), (GOAL, "I added a guard to scan_a.\n- After that, check whether", "truncated"), ("Behebe den Fehler in scan_a, der nach dem Neustart auftritt", "Ich habe scan_a geändert.\n1. Danach wird der", "truncated"),
    (GOAL, "I added a guard to scan_a.\n- Close the file before the run\n- Plan A", None), (GOAL, "I added a guard to scan_a.\n1. the", None),
    (GOAL, "See https://a.example/b", None), (None, "I added a guard to scan_a.", None),
]


@pytest.mark.parametrize(("goal", "answer", "defect"), CASES)
def test_defects(goal, answer, defect):
    assert pairs.defect_of(goal, answer, pairs.trained()) == defect


def accuracy(train, test):
    """Share of the held-out clauses that a field fitted to ``train`` tags right; ``test`` has (goal, parts, tags, held-out places)."""
    model = ChainCRF(pairs.TAGS).fit([pairs.features(g, p) for g, p, _ in train], [t for _, _, t in train])
    got = model.tag_all([pairs.features(g, p) for g, p, _, _ in test])
    marks = [x[k] == t[k] for x, (_, _, t, held) in zip(got, test) for k in held]
    return sum(marks) / len(marks), len(marks)


def split(held):
    """Rows without any held-out clause, and those with one."""
    rows = [(g, pairs.clauses(a), t) for g, a, t in pair_examples.labelled()]
    marked = [(g, p, t, [k for k, (_, text) in enumerate(p) if held(text)]) for g, p, t in rows]
    return [r[:3] for r in marked if not r[3]], [r for r in marked if r[3]]


def test_accuracy_on_clauses_never_trained_on():
    """A fifth of the distinct clauses is held out: no example that has one of them is trained on."""
    texts = sorted({text for _, a, _ in pair_examples.labelled() for _, text in pairs.clauses(a)})
    random.Random(2).shuffle(texts)
    right = []
    for fold in range(5):
        held = set(texts[fold::5])
        train, test = split(lambda text: text in held)
        right.append(accuracy(train, test))
    assert sum(r * n for r, n in right) / sum(n for _, n in right) > 0.85, right


@pytest.mark.parametrize("language", ["de", "fr", "ru", "zh"])
def test_accuracy_on_a_language_never_trained_on(language):
    own = [pair_examples.GOALS, pair_examples.ANSWERS, pair_examples.REFUSALS, pair_examples.UNFINISHED]
    held = [x for table in own for x in table[language]]
    train, test = split(lambda text: any(text in h or h in text for h in held))
    right, n = accuracy([r for r in train if r[0] not in held], test)
    assert n > 20 and right > 0.75, right


def test_column(spark):
    rows = [(k, g, a, "x") for k, (g, a, _) in enumerate(CASES)] + [(None, GOAL, None, "x"), (900, GOAL, "word and more. " * 30_000, "x")]
    out = pairs.defective_pairs(spark.createDataFrame(rows, "traj_id long, goal string, final_answer string, defect string"), "traj_id", "goal", "final_answer")
    got = {r["traj_id"]: r["defect"] for r in out.collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(CASES) if d} | {None: "empty"}
    assert out.limit(0).count() == 0
