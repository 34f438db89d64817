"""What a text must hold for a pattern to match: lossless guards before costly patterns."""

from __future__ import annotations

import re
from itertools import product
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column

#: Strings that a stretch of a pattern is spelled out into at most, and strings that a guard looks for at most.
SPELLED, GUARDS = 64, 12


def _spelled(op, args) -> set[str] | None:
    """All strings that an item of a pattern matches, if they are few."""
    if op is c.LITERAL:
        return {chr(args)}
    if op is c.AT:
        return {""}
    if op is c.SUBPATTERN:
        return _sequence(args[-1])
    if op is c.BRANCH:
        each = [_sequence(x) for x in args[1]]
        return None if None in each else set().union(*each)
    if op is c.MAX_REPEAT and args[1] <= 1:
        inner = _sequence(args[2])
        return None if inner is None else inner | ({""} if args[0] == 0 else set())
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, args in items:
        more = _spelled(op, args)
        if more is None or len(out) * len(more) > SPELLED:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _needed(items) -> set[str]:
    """Strings of which every match of a sequence holds one; the choice whose shortest is longest. Holds "" if there is none."""
    runs, at = [], {""}
    for op, args in items:
        more = _spelled(op, args)
        if more is not None and len(at) * len(more) <= SPELLED:
            at = {a + b for a, b in product(at, more)}
            continue
        runs.append(at)
        at = more if more is not None and len(more) <= SPELLED else {""}
        if more is None and op is c.BRANCH:
            runs.append(set().union(*(_needed(x) for x in args[1])))
        elif more is None and op is c.SUBPATTERN:
            runs.append(_needed(args[-1]))
        elif more is None and op is c.MAX_REPEAT and args[0] >= 1:
            runs.append(_needed(args[2]))
    return max([*runs, at], key=lambda r: min(map(len, r)))


def needed(pattern: str) -> set[str]:
    """Strings of which every match of a pattern holds at least one; an empty string means that there is no such set, as for patterns
    that ignore the case."""
    tree = parser.parse(pattern)
    return {""} if tree.state.flags & re.IGNORECASE else _needed(tree)


def matches(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, tried only where a string that every match holds occurs; the same result."""
    strings = sorted(needed(pattern))
    if "" in strings or len(strings) > GUARDS:
        return text.rlike(pattern)
    guard = text.contains(strings[0])
    for s in strings[1:]:
        guard = guard | text.contains(s)
    return guard & text.rlike(pattern)
