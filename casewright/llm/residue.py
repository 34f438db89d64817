"""Values that nobody wrote: templates with open slots, filler, error pages, notices about scripts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import residue_examples as examples
from casewright.plans.session import cut

#: Tokens of a window and of the step to the next; containment from which a window is residue; share of the value that
#: residue windows must cover.
WINDOW, STEP, CONTAINED, COVERAGE = 16, 8, 0.7, 0.8
#: Words on either side of a slot that belong to a template with several.
BESIDE = 2
#: Distinct tokens that a task counts before it hands on what it has.
COUNTED = 100_000

# A slot ends where the next of its kind could begin, so none is too long and a text of open brackets costs no more than its length.
_SLOT = (
    r"\{\{[^{}]*+\}\}|\{%[^%{}]*+%\}|\$\{[^{}]*+\}|%\(\w+\)[sd]|&lt;&lt;[^&<>\n]++&gt;&gt;|&lt;[\w ]++&gt;|<<[\w ]++>>|<(?!/|noscript|br|p>|div|html|head|body|title|center|script|span|meta|link|style|table|tr|td|ul|li|b>|i>|a\b|hr|h\d)[a-z][\w ]*+>"
    r"|\[(?:your|insert|enter|add|put|my|the)\b[^\]\[]*+\]|__[A-Z][A-Z_]*__|#?\{[\w ]*+\}|%[A-Z_]{2,}%|@@\w+@@"
)
_TOKEN = regex.compile(
    rf"(?i:(?P<slot>{_SLOT}))|(?P<tag></?\w+/?>)|(?P<host>(?i:https?://[\w.\-/?=&%#~]+|\b[\w\-]+(?:\.[\w\-]+)*\.(?:example|invalid|test|com|org|net|io|dev|local)\b[\w./\-]*|\blocalhost\b))"
    r"|(?P<who>(?i:\bagent-\w\b))|(?P<server>\b[\w\-]+/\d+(?:\.\d+)+)|(?P<ident>\b\w*\p{L}\w*_\w+|\b[\p{L}][\w\-]*(?:/[\w.\-]+)+|\b\w+\.\w*[a-z]\w*\b(?<!\bmax\.\w*))"
    r"|(?P<path>(?<!\w)/[\w./\-]+)|(?P<id>\b(?=\w*\d)(?=\w*[a-fA-F])[0-9a-fA-F]{4,}(?:-\w+)*\b|#\w*\d\w*)|(?P<num>\b\d[\d.,]*\b)|(?P<word>[\p{L}']+)",

)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
_HAN = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}")
_MARKS = {"x": "{slot}", "n": "12", "i": "a1b2c3", "h": "https://a.example", "p": "/a/b", "who": "agent-a", "server": "proxy/1.2.3"}


@lru_cache(100_000)
def _word(w: str) -> str:
    """A word's token: ``<mash>`` for keyboard runs and repeated letters, else the word in lower case."""
    w = w.lower().strip("'")
    if len(w) >= 3 and (len(set(w)) == 1 or any(w in r for r in _ROWS) or len(w) % 2 == 0 and w[: len(w) // 2] == w[len(w) // 2 :] and len(w) >= 6 and any(w[: len(w) // 2] in r for r in _ROWS)):
        return "<mash>"
    return w


def tokens_of(text: str) -> list[str]:
    """Tokens of a value in order: words, and classes for slots, hosts, numbers, ids, paths, servers and identifiers.

    A text in capitals is read in lower case, but for what makes its slots.
    """
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            w = m.group()
            out += [c for c in w if _HAN.match(c)] if _HAN.search(w) else [_word(w)] if w.strip("'") else []
        elif kind == "ident" and m.group().strip("_.").isupper() and _SHOUTED.fullmatch(m.group()):
            out.append(m.group().lower())
        else:
            out.append(f"<{kind}>")
    return out


_SAID = {"<ident>", "<num>", "<id>"}
_SHOUTED = regex.compile(r"(?:ERR|DNS|NET)_[A-Z_]+")


class Exemplars:
    """The exemplars behind an inverted index from pairs of neighbouring tokens (and single filler tokens)."""

    def __init__(self) -> None:
        #: the labels of the exemplars that have a pair, in the order of the library
        self.pairs: dict[tuple[str, str], tuple[str, ...]] = {}
        self.alone = {_word(w) for w in examples.FILLER} | {"<slot>", "<mash>"}
        self.whole: set[tuple[str, ...]] = set()
        self.bonds: set[tuple[str, str]] = set()
        for label, text in examples.exemplars():
            for mark, value in _MARKS.items():
                text = text.replace("{" + mark + "}", value)
            tokens = tuple(tokens_of(text))
            if len(tokens) == 1 and label != "written":
                self.whole.add(tokens)
            for pair in set(zip(tokens, tokens[1:])):
                known = self.pairs.get(pair, ())
                if label not in known:
                    self.pairs[pair] = (*known, label)
                if label != "written":
                    self.bonds.add(pair)

    def _generic(self, tokens: list[str]) -> set[int]:
        """Places that exemplars without words of their own hold: a word again and again, a value of one stand-in, and what
        stands within ``BESIDE`` of a slot among several, unless identifiers or numbers say something."""
        held = {j for k, pair in enumerate(zip(tokens, tokens[1:])) if pair[0] == pair[1] and pair[0][0] != "<" for j in (k, k + 1)}
        if len(tokens) == 1 and tuple(tokens) in self.whole:
            held.add(0)
        slots = [k for k, t in enumerate(tokens) if t == "<slot>"]
        if len(slots) >= 2 and not _SAID.intersection(tokens):
            held.update(j for k in slots for j in range(max(0, k - BESIDE), min(len(tokens), k + BESIDE + 1)))
        return held

    def reach(self, tokens: list[str]) -> list[bool]:
        """The tokens that any window can have in common with exemplars of residue; all others stay uncovered."""
        marks = [t in self.alone for t in tokens]
        for k, pair in enumerate(zip(tokens, tokens[1:])):
            if pair in self.bonds or pair[0] == pair[1]:
                marks[k] = marks[k + 1] = True
        slots = [k for k, t in enumerate(tokens) if t == "<slot>"]
        for k in slots if len(slots) >= 2 else ():
            for j in range(max(0, k - BESIDE), min(len(tokens), k + BESIDE + 1)):
                marks[j] = True
        if len(tokens) == 1 and tuple(tokens) in self.whole:
            marks[0] = True
        return marks

    def covered(self, window: list[str], weight: dict[str, float], most: float) -> list[bool]:
        """The tokens of a window that exemplars of one label hold beside the same neighbour, for the label that holds the
        greatest weight; none where that is the label of written texts."""
        hits: dict[str, set[int]] = {"any": held} if (held := self._generic(window)) else {}
        for k, pair in enumerate(zip(window, window[1:])):
            for label in self.pairs.get(pair, ()):
                hits.setdefault(label, set()).update((k, k + 1))
        best = alone = [w in self.alone for w in window]
        gain = sum(weight.get(w, most) for w, b in zip(window, best) if b)
        for label, held in hits.items():
            marks = [m or k in held for k, m in enumerate(alone)]
            value = sum(weight.get(w, most) for w, m in zip(window, marks) if m)
            if value > gain:
                best, gain = [label != "written" and m for m in marks], value
        return best

    def coverage(self, tokens: list[str], weight: dict[str, float], most: float) -> float:
        """TF-IDF share of a value that lies in residue windows; 1 for a value without words (of punctuation)."""
        tokens = [t for t in tokens if t != "<tag>"]
        if not tokens:
            return 1.0
        w = [weight.get(t, most) for t in tokens]
        total = sum(w)
        if sum(x for x, m in zip(w, self.reach(tokens)) if m) < (COVERAGE - 1e-9) * total:
            return 0.0
        inside = [False] * len(tokens)
        for begin in range(0, max(1, len(tokens) - WINDOW + STEP), STEP):
            part = tokens[begin : begin + WINDOW]
            marks = self.covered(part, weight, most)
            mass = sum(w[begin : begin + WINDOW])
            if mass and sum(x for x, m in zip(w[begin:], marks) if m) >= CONTAINED * mass:
                for k, m in enumerate(marks):
                    inside[begin + k] |= m
        hit = sum(x for x, i in zip(w, inside) if i)
        return hit / total


@lru_cache(1)
def index() -> Exemplars:
    return Exemplars()


def residue_values(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Records whose whole value is residue: columns ``keys``, ``coverage``.

    Labelled exemplars (a fixed library, broadcast as part of the task) are retrieved through an inverted index of
    neighbouring tokens; a window of the value is residue when the TF-IDF weight of the tokens that it has in common
    with exemplars of one label is at least ``CONTAINED`` of its own, a value when such windows cover ``COVERAGE`` of its
    weight. Document frequencies are those of all tokens over all values. A weight lies between log 2 (in every value)
    and log(1 + values), so a value in which even at these bounds the tokens beside a neighbour of the library can't reach
    the coverage is no residue; one pass over the texts yields both the frequencies, added up in each task, and the tokens
    of the other values. Each of these is joined to the frequencies of its own tokens and compared in full. No text is
    shuffled; tokens and counts are cut to the shared folder.

    Null, empty and blank values are no residue; a value of punctuation only stands for none and is. Values of any length are read whole. Rows repeated in ``df`` are
    repeated in the result and count in the frequencies. Other columns are not read. An empty table gives an empty result.
    """
    source = df.select(*keys, F.col(text).alias("_t")).where(F.col("_t").rlike(r"[^\s\p{C}\p{Z}]"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    lean = math.log(1 + max(1, df.count())) / math.log(2)  # blank values too: the bound is only looser

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = index()
        frequency: Counter[str] = Counter()
        values = 0

        def counted() -> pd.DataFrame:
            rows = [*frequency.items(), ("<all>", values)]
            return pd.DataFrame({**{c: [None] * len(rows) for c in keys}, "_tokens": None, "_term": [r[0] for r in rows], "_n": [r[1] for r in rows]})

        for batch in batches:
            keep, lists = [], []
            for k, t in enumerate(batch["_t"]):
                tokens = [x for x in tokens_of(t) if x != "<tag>"]
                values += 1
                frequency.update(set(tokens))
                near = sum(library.reach(tokens))
                if near * lean >= (COVERAGE - 1e-9) * (near * lean + len(tokens) - near):
                    keep.append(k)
                    lists.append(tokens)
            if keep:
                out = batch.iloc[keep][keys].copy()
                out["_tokens"], out["_term"], out["_n"] = lists, None, None
                yield out
            if len(frequency) > COUNTED:
                yield counted()
                frequency.clear()
                values = 0
        yield counted()

    passed = cut(source.mapInPandas(first, f"{kinds}, _tokens array<string>, _term string, _n bigint"))
    counts = passed.where("_term IS NOT NULL").groupBy("_term").agg(F.sum("_n").alias("_n"))
    every = max(1, passed.where("_term = '<all>'").agg(F.sum("_n")).first()[0] or 0)
    most = math.log(1 + every)

    some = passed.withColumn("_row", F.monotonically_increasing_id()).where("_term IS NULL").select("_row", *keys, "_tokens")
    pairs = some.select("_row", F.explode(F.array_distinct("_tokens")).alias("_term")).join(counts, "_term")
    known = pairs.groupBy("_row").agg(F.collect_list("_term").alias("_terms"), F.collect_list("_n").alias("_counts"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = index()
        for batch in batches:
            out = batch[keys].copy()
            out["coverage"] = [
                library.coverage(list(t), {} if terms is None else {x: math.log(1 + every / n) for x, n in zip(terms, ns)}, most)
                for t, terms, ns in zip(batch["_tokens"], batch["_terms"], batch["_counts"])
            ]
            yield out[out["coverage"] >= COVERAGE]

    return some.join(known, "_row", "left").select(*keys, "_tokens", "_terms", "_counts").mapInPandas(second, f"{kinds}, coverage double")
