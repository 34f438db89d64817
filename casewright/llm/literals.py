"""Many patterns over one text, only those tried that can match."""

from __future__ import annotations

import re

import ahocorasick

from casewright.functions.patterns import needed


class Sieve:
    """Patterns by name; ``names`` gives those that match a text, trying only the ones whose needed strings occur."""

    def __init__(self, patterns: dict[str, str]):
        self.forms = {n: re.compile(p) for n, p in patterns.items()}
        self.always = [n for n, p in patterns.items() if "" in needed(p)]
        found: dict[str, set[str]] = {}
        for n, p in patterns.items():
            for s in needed(p) if n not in self.always else ():
                found.setdefault(s, set()).add(n)
        self.machine = ahocorasick.Automaton()
        for s, names in found.items():
            self.machine.add_word(s, tuple(sorted(names)))
        if found:
            self.machine.make_automaton()
        self.some = bool(found)

    def names(self, text: str) -> list[str]:
        """Names of the patterns that match, in their order."""
        maybe = set(self.always)
        if self.some:
            for _, names in self.machine.iter(text):
                maybe.update(names)
        return [n for n, form in self.forms.items() if n in maybe and form.search(text)] if maybe else []
