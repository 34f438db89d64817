"""Pages of repeated keywords, links or product tags instead of sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.language import FUNCTION_WORDS

#: A repeat counts from so many occurrences and so many characters on; a piece is covered from this share on.
OCCURRENCES, LEAST_CHARS, COVERED = 3, 4, 0.5

_FUNCTION = {w for v in FUNCTION_WORDS.values() for w in v.split()}
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_TOKEN = regex.compile(r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|#[\p{L}\p{N}_]+|\p{Han}|\p{N}+(?:[.,]\p{N}+)*|[\p{L}_][\p{L}\p{N}_.\-]*|[^\s\p{L}\p{N}]")
_HUMP = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+")
_DIGITS = regex.compile(r"\p{N}+")
_FINAL = re.compile(r"[.!?…]\s|[。！？]")
_ENDED = re.compile(r"[.!?]\W*$")
_COMMAS = re.compile(r"[,;|/]\s")
_HAN = regex.compile(r"\p{Han}")
# Characters that Chinese clauses are made with.
_PARTICLES = frozenset("的了是在和不也就都而及与着或把被从对为以到这那它他她我你们会可能要让将已未请并且但因所如果则时后前有没些还再才只很更吗呢吧之其于由此些")
_SENTENCE = regex.compile(r"(?<=[.!?…]\s)|(?<=[。！？])")
_LINKISH = regex.compile(r"https?://|www\.|href=", regex.I)
#: A setting ``key: value``; an address is none, nor is what a listing says of a product. A keyword of code has a sign beside
#: the ones of addresses.
_STRUCTURED = regex.compile(
    r"^\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d|\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)(?:\]|:|\s+\S*[\p{N}_:\[])|(?:user|assistant|tool|system|human|bot|agent)\s*:|#{1,6}\s|```|(?:def|class|import|return|assert|raise|const|let|var|export|curl|git)\b.*[=(){}\[\]:]|(?:from|if|for|while)\b(?:https?://\S+|www\.\S+|[^=(){}\[\]:])*+[=(){}\[\]:]|[\w.\-]+\s*=\s|(?!(?i:sku|price|discount|sale|offer)s?:)[\w.\-]+:\s*(?!\S*//|(?i:www\.)|\p{Sc}\p{N})\S*$|@@|\$ |>>> |-----|(?:[0-9a-f]{2,8}[: ]+){6,}|[A-Za-z0-9+/=]{40,}$)"
)


class SuffixAutomaton:
    """All substrings of a sequence of symbols, with their numbers of occurrences; linear in the sequence."""

    def __init__(self, symbols: list[str]):
        go: list[dict[str, int]] = [{}]
        link, length, count = [-1], [0], [0]
        last, self.prefix = 0, []
        for s in symbols:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(1)
            p = last
            while p >= 0 and s not in go[p]:
                go[p][s] = cur
                p = link[p]
            if p >= 0:
                q = go[p][s]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    count.append(0)
                    while p >= 0 and go[p].get(s) == q:
                        go[p][s] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
            self.prefix.append(cur)
        order = sorted(range(1, len(go)), key=length.__getitem__)
        for v in reversed(order):
            count[link[v]] += count[v]
        self.link, self.length, self.count, self.order = link, length, count, order

    def repeats(self, least: int) -> list[int]:
        """For every position, the length of the longest substring ending there that occurs ``least`` times or more."""
        best = [0] * len(self.length)
        for v in self.order:
            best[v] = self.length[v] if self.count[v] >= least else best[self.link[v]]
        return [best[v] for v in self.prefix]


def _symbols(tokens: list[str]) -> list[tuple[str, int]]:
    """(symbol, characters) of tokens: words in lower case, parts of hashtags, one symbol for all addresses and one for all numbers."""
    out = []
    for t in tokens:
        c = t[0]
        if c in "hHwW" and _LINKISH.match(t):
            out.append(("\x01link", len(t)))
        elif c == "#" and len(t) > 1:
            parts = _HUMP.findall(t[1:])
            out.append(("\x01tag", 1))
            out += [(p.lower(), len(p)) for p in parts] if len(parts) > 1 else [("\x01tagged", len(t) - 1)]
        elif c.isdigit():
            out.append(("\x01number", len(t)))
        else:
            out.append((t.lower() if t.isalpha() else _DIGITS.sub("0", t.lower()), len(t)))
    return out


def _covered(symbols: list[tuple[str, int]]) -> list[bool]:
    """Which symbols lie in substrings that occur ``OCCURRENCES`` times or more and have ``LEAST_CHARS`` characters.

    A symbol that itself occurs less often is in none of them, so the automaton reads it as one and the same break, and a
    sequence without frequent symbols needs none."""
    often = {s for s, n in Counter(s for s, _ in symbols).items() if n >= OCCURRENCES}
    covered = [False] * len(symbols)
    if not often:
        return covered
    # a break must not repeat itself: each gets its own name
    lengths = SuffixAutomaton([s if s in often else f"\x02{k}" for k, (s, _) in enumerate(symbols)]).repeats(OCCURRENCES)
    reach = len(symbols)
    for k in range(len(symbols) - 1, -1, -1):
        begin = k - lengths[k] + 1
        if lengths[k] and sum(c for _, c in symbols[max(begin, k - 3) : k + 1]) >= LEAST_CHARS:
            reach = min(reach, begin)
        if reach <= k:
            covered[k] = True
        else:
            reach = len(symbols)
    return covered


def _has_clause(tokens: list[str], piece: str) -> tuple[bool, bool]:
    """Whether a piece has a clause, and whether at least a fourth of it are addresses and hashtags."""
    words = used = shown = 0
    different = set()
    for t in tokens:
        c = t[0]
        if c in "hHwW" and _LINKISH.match(t):
            shown += 1
        elif c == "#" and len(t) > 1:
            shown += 1
            parts = _HUMP.findall(t[1:])
            if len(parts) > 1:
                for p in parts:
                    words += p[0].isalpha()
                    if (w := p.lower()) in _FUNCTION:
                        used += 1
                        different.add(w)
        elif c.isalpha():
            words += 1
            if (w := t.lower()) in _FUNCTION:
                used += 1
                different.add(w)
    links = shown * 4 >= max(1, words)
    if len(different) >= 2 and used * 8 >= words and words > 3 * shown:
        return True, links
    if used and not shown and _ENDED.search(piece) and 8 * len(_COMMAS.findall(piece)) <= words:
        return True, links
    if len(different) >= 2 and piece.lstrip().startswith("|"):
        return True, links
    if not piece.isascii() and _HAN.search(piece):
        letters = len(_HAN.findall(piece))
        of = [c for c in piece if c in _PARTICLES]
        return len(set(of)) >= 2 and 12 * len(of) >= letters > 8 * shown, links
    return False, links


def stuffed_share(text: str | None, least: float = 0.5) -> float:
    """Share of a text's words in pieces that are repeated keywords, links or product tags; 0 for a text without words,
    and for one whose pieces without clause hold no more than the share ``least``.

    Pieces are the sentences of lines. A piece with clauses is none: at least two different function words that
    make up an eighth of it (of Chinese characters a twelfth), or one in a sentence with its final mark and few commas. Nor is a
    structured line: log, transcript, code, heading, setting, dump, fenced block.
    Of the others, addresses and hashtags are stuffing as such; else the share of the piece's characters that maximal
    repeated substrings of the page cover decides.
    """
    if not text:
        return 0.0
    total = stuffed = maybe = 0
    fenced = False
    open_pieces: list[tuple[int, list[str], bool]] = []
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            fenced = not fenced
            total += len(_WORD.findall(line))
        elif fenced or _STRUCTURED.match(line):
            total += len(_WORD.findall(line))
        else:
            for piece in _SENTENCE.split(line) if _FINAL.search(line) else [line]:
                n = len(_WORD.findall(piece))
                total += n
                if not n:
                    continue
                tokens = _TOKEN.findall(piece)
                clause, links = _has_clause(tokens, piece)
                if not clause:
                    maybe += n
                    open_pieces.append((n, tokens, links))
    if not open_pieces or maybe / total <= least:
        return 0.0
    parts = [_symbols(tokens) for _, tokens, _ in open_pieces]
    covered = _covered([x for part in parts for x in part])
    at = 0
    for (n, _, links), part in zip(open_pieces, parts):
        chars = sum(c for _, c in part)
        hit = sum(c for k, (_, c) in enumerate(part) if covered[at + k])
        at += len(part)
        if links or hit >= COVERED * chars:
            stuffed += n
    return stuffed / total if total else 0.0


def stuffed_pages(df: DataFrame, key: str, text: str, share: float = 0.5) -> DataFrame:
    """Pages of whose words more than ``share`` are stuffing: columns ``key``, ``stuffed_share``.

    One pass without shuffle in Arrow batches; a suffix automaton per page, linear in its length. Its symbols are words
    (cost per word, coverage counted in characters); pages in which the pieces without clause can't reach ``share``
    need none. Null, empty and blank texts have no words and are left out. Texts are read whole. Null keys are kept;
    rows repeated in ``df`` are repeated in the result. Other columns are not read.
    """
    source = df.select(F.col(key).alias(key), F.col(text).alias("_t")).where("_t IS NOT NULL")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({key: batch[key], "stuffed_share": [stuffed_share(t, share) for t in batch["_t"]]})
            yield out[out["stuffed_share"] > share]

    return source.mapInPandas(run, f"`{key}` {kind}, stuffed_share double")
