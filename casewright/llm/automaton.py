"""A deterministic automaton over many linear patterns, run over many text chunks at once."""

from __future__ import annotations

import numpy as np

#: Longest stretch a pattern may span, and length of a chunk; chunks overlap by the span, so no match is cut.
SPAN, CHUNK = 96, 1024
#: Characters that are scanned at once; they take some ten bytes each, however many texts a batch holds and however long.
AT_ONCE = 1 << 20
#: Stands for any character beyond ASCII in a pattern.
BEYOND = "\x80"


class Automaton:
    """Subset construction of patterns that are sequences of ``(characters, least, most)``.

    ``characters`` is a set of ASCII characters and ``BEYOND``, which any other character is; ``most`` bounds the
    repetition. ``scan`` reports, for every place where a pattern is complete, its number.
    """

    def __init__(self, patterns: list[list[tuple[frozenset[str], int, int]]]):
        if any(sum(most for _, _, most in p) > SPAN for p in patterns):
            raise ValueError(f"a pattern is longer than {SPAN} characters")
        distinct = sorted({p[0] for q in patterns for p in q}, key=sorted)
        signature = {chr(c): tuple(chr(c) in s for s in distinct) for c in range(129)}
        kinds = {s: k + 1 for k, s in enumerate(sorted(set(signature.values())))}
        self.symbol = np.zeros(129, np.uint8)  # 128: all that isn't ASCII
        for c in range(129):
            self.symbol[c] = kinds[signature[chr(c)]]
        member = {k: {i for i, s in enumerate(distinct) if sig[i]} for sig, k in kinds.items()}
        number = {s: i for i, s in enumerate(distinct)}

        # a position (p, i, n): in pattern p, step i has been met n times
        def close(at: set[tuple[int, int, int]]) -> frozenset:
            todo, out = list(at), set(at)
            while todo:
                p, i, n = todo.pop()
                if i < len(patterns[p]) and n >= patterns[p][i][1] and (p, i + 1, 0) not in out:
                    out.add((p, i + 1, 0))
                    todo.append((p, i + 1, 0))
            return frozenset(out)

        begin = close({(p, 0, 0) for p in range(len(patterns))})
        states, order, table, done = {begin: 0}, [begin], [], []
        for state in order:
            done.append(sorted({p for p, i, n in state if i == len(patterns[p])}))
            row = [0] * (len(kinds) + 1)
            for k in range(1, len(kinds) + 1):
                to = set()
                for p, i, n in state:
                    if i < len(patterns[p]) and number[patterns[p][i][0]] in member[k] and n < patterns[p][i][2]:
                        to.add((p, i, n + 1))
                after = frozenset(close(to) | begin)
                if after not in states:
                    states[after] = len(order)
                    order.append(after)
                row[k] = states[after]
            table.append(row)
        self.kinds = len(kinds) + 1
        self.table = np.array(table, np.int32)
        self.done = done
        self.final = np.array([bool(d) for d in done])

    def scan(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Distinct (text, end, pattern), in order; ``end`` is the offset after the pattern's last character.

        Texts are scanned ``AT_ONCE`` characters at a time; one that is longer goes in pieces that overlap by ``SPAN``."""
        found: set[tuple[int, int, int]] = set()
        pieces: list[tuple[int, int, str]] = []
        size = 0
        for t, text in enumerate(texts):
            for begin in range(0, max(1, len(text) - SPAN), AT_ONCE - SPAN):
                piece = text if len(text) <= AT_ONCE else text[begin : begin + AT_ONCE]
                if pieces and size + len(piece) > AT_ONCE:
                    self._scan(pieces, found)
                    pieces, size = [], 0
                pieces.append((t, begin, piece))
                size += len(piece)
        self._scan(pieces, found)
        return sorted(found)

    def _scan(self, pieces: list[tuple[int, int, str]], found: set[tuple[int, int, int]]) -> None:
        sizes = np.fromiter((len(p) for _, _, p in pieces), np.int64, len(pieces)) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(p + "\0" for _, _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[np.minimum(points, 128)]
        stride = CHUNK - SPAN
        n = max(1, -(-len(symbols) // stride))
        padded = np.zeros(n * stride + SPAN, np.uint8)
        padded[: len(symbols)] = symbols
        chunks = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::stride]
        columns = np.ascontiguousarray(chunks.T)
        state = np.zeros(n, np.int32)
        spots, seen = [], []
        flat = self.table.ravel()
        for j in range(CHUNK):
            state = flat[state * self.kinds + columns[j]]
            hit = np.flatnonzero(self.final[state])
            if len(hit):
                spots.append(hit * stride + j)
                seen.append(state[hit])
        if not spots:
            return
        at, states = np.concatenate(spots), np.concatenate(seen)
        which = np.searchsorted(starts, at, side="right") - 1
        ends = at - starts[which] + 1
        for k, e, s in zip(which.tolist(), ends.tolist(), states.tolist()):
            t, begin, _ = pieces[k]
            found.update((t, begin + e, p) for p in self.done[s])
