"""The sieve against plain search."""

import random
import re

import pytest

from casewright.functions.patterns import needed
from casewright.llm import pair_examples, pairs
from casewright.llm.literals import Sieve


@pytest.mark.parametrize(
    ("pattern", "strings"),
    [("abc", {"abc"}), (r"\b(?:ab|cd)\b.*x", {"ab", "cd"}), ("a?b", {"ab", "b"}), (r"ab+c", {"a"}), (r"(?:foo|b\w)z", {"foo", "b"}), (r"\w+", {""}), ("x[yz]long", {"long"}), ("(?:ab){2}cde", {"cde"})],
)
def test_needed(pattern, strings):
    assert needed(pattern) == strings


def test_sieve_equals_search():
    sieve = Sieve(pairs._CUES)
    rng = random.Random(8)
    texts = [text for goal, answer, _ in pair_examples.labelled() for text in (goal, answer)]
    pieces = sorted({w for t in texts for w in re.findall(r"\S+\s*", t)} | {w for s in (needed(p) for p in pairs._CUES.values()) for w in s})
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    hits = 0
    for t in texts:
        want = [n for n, p in pairs._CUES.items() if re.search(p, t.lower())]
        hits += len(want)
        assert sieve.names(t.lower()) == want
    assert hits > 1000
