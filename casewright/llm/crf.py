"""A linear-chain conditional random field over binary features, in numpy."""

from __future__ import annotations

from collections import Counter

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    """Tags sequences of feature lists; features never seen in training carry no weight."""

    def __init__(self, tags: list[str]):
        self.tags = tags
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(tags)))
        self.t = np.zeros((len(tags), len(tags)))

    def fit(self, sequences: list[list[list[str]]], labels: list[list[str]], rounds: int = 200, rate: float = 0.1, l2: float = 2e-3) -> "ChainCRF":
        """Maximum likelihood by Adam over all sequences at once; deterministic. Equal examples are counted, not repeated."""
        counts = Counter((tuple(tuple(sorted(set(x))) for x in s), tuple(l)) for s, l in zip(sequences, labels))
        total, many = len(sequences), np.array(list(counts.values()), float)[:, None, None]
        sequences, labels = [s for s, _ in counts], [l for _, l in counts]
        self.index = {f: k for k, f in enumerate(sorted({f for s in sequences for x in s for f in x}))}
        n, length, k = len(sequences), max(map(len, sequences)), len(self.tags)
        x = np.zeros((n, length, len(self.index)), np.float64)
        y = np.zeros((n, length, k))
        mask = np.zeros((n, length), bool)
        for i, (s, l) in enumerate(zip(sequences, labels)):
            for j, (fs, tag) in enumerate(zip(s, l)):
                x[i, j, [self.index[f] for f in fs]] = 1
                y[i, j, self.tags.index(tag)] = 1
                mask[i, j] = True
        pairs = np.einsum("nia,nib->ab", many * y[:, :-1], y[:, 1:])
        w, t = np.zeros((len(self.index), k)), np.zeros((k, k))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        for r in range(1, rounds + 1):
            e = x @ w
            alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = e[:, 0]
            for j in range(1, length):
                step = _lse(alpha[:, j - 1, :, None] + t, 1) + e[:, j]
                alpha[:, j] = np.where(mask[:, j, None], step, alpha[:, j - 1])
            z = _lse(alpha[:, -1], 1)
            for j in range(length - 2, -1, -1):
                step = _lse(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where(mask[:, j + 1, None], step, beta[:, j])
            p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            expected = np.zeros((k, k))
            for j in range(1, length):
                q = alpha[:, j - 1, :, None] + t + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]
                expected += (np.exp(q) * mask[:, j, None, None] * many).sum(0)
            gw = np.einsum("nlf,nlk->fk", x, many * (y - p), optimize=True) / total - l2 * w
            gt = (pairs - expected) / total - l2 * t
            for g, v, (a, b) in ((gw, w, (0, 1)), (gt, t, (2, 3))):
                state[a] = 0.9 * state[a] + 0.1 * g
                state[b] = 0.99 * state[b] + 0.01 * g * g
                v += rate * (state[a] / (1 - 0.9**r)) / (np.sqrt(state[b] / (1 - 0.99**r)) + 1e-8)
        self.w, self.t = w, t
        return self

    def tag(self, sequence: list[list[str]]) -> list[str]:
        """The likeliest tags of one sequence."""
        return self.tag_all([sequence])[0]

    def tag_all(self, sequences: list[list[list[str]]]) -> list[list[str]]:
        """The likeliest tags of many sequences, place by place for all of them at once, the longest first."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        lengths = np.array([len(sequences[k]) for k in order])
        out: list[list[str]] = [[] for _ in sequences]
        if not lengths.size or not lengths[0]:
            return out
        flat = [[self.index[f] for f in fs if f in self.index] for k in order for fs in sequences[k]]
        spots = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
        scores = np.zeros((len(flat), len(self.tags)))
        np.add.at(scores, spots, self.w[np.array([i for x in flat for i in x], np.int64)])
        starts = np.cumsum(lengths) - lengths
        live = [int((lengths > j).sum()) for j in range(int(lengths[0]))]
        score = scores[starts[: live[0]]]
        backs, ended = [], [None] * len(order)
        for j, n in enumerate(live):
            if j:
                step = score[:n, :, None] + self.t
                backs.append(step.argmax(1))
                score = step.max(1) + scores[starts[:n] + j]
            for r in range(live[j + 1] if j + 1 < len(live) else 0, n):
                ended[r] = int(score[r].argmax())
        for r, k in enumerate(order[: live[0]]):
            best = [ended[r]]
            for j in range(int(lengths[r]) - 2, -1, -1):
                best.append(int(backs[j][r][best[-1]]))
            out[k] = [self.tags[b] for b in reversed(best)]
        return out
