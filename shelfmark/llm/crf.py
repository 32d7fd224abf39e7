"""A linear-chain conditional random field over sets of named features."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Labels of the items of a sequence, scored by each item's features and by
    neighbouring labels.

    ``fit`` maximises the likelihood of labelled sequences, held in the
    caller's memory: pass it a bounded sample. ``decode`` gives the best
    labelling by Viterbi's algorithm. Features not met in fitting score zero.
    """

    def __init__(self, labels: int):
        self.labels = labels
        self.scores: dict[str, tuple[float, ...]] = {}
        self.step = np.zeros((labels, labels))
        self.first = np.zeros(labels)
        self.last = np.zeros(labels)

    def fit(
        self,
        sequences: list[list[list[str]]],
        labels: list[list[int]],
        rounds: int = 150,
        penalty: float = 0.01,
        rate: float = 0.15,
    ) -> Crf:
        """Full-batch gradient ascent (Adam) on the penalised log-likelihood."""
        kept = [k for k, s in enumerate(sequences) if s]
        sequences, labels = [sequences[k] for k in kept], [labels[k] for k in kept]
        if not sequences:
            return self
        names = {f: i for i, f in enumerate(sorted({f for s in sequences for x in s for f in x}))}
        n, K, longest = len(sequences), self.labels, max(map(len, sequences))
        lengths = np.array([len(s) for s in sequences])
        rows = np.arange(n)
        gold = np.zeros((n, longest), np.int64)
        owner, feature = [], []
        for i, (s, own) in enumerate(zip(sequences, labels)):
            gold[i, : len(s)] = own
            for t, fs in enumerate(s):
                owner += [i * longest + t] * len(fs)
                feature += [names[f] for f in fs]
        owner, feature = np.array(owner, np.int64), np.array(feature, np.int64)
        there = np.arange(longest)[None, :] < lengths[:, None]
        truth = np.zeros((n, longest, K))
        truth[there] = np.eye(K)[gold[there]]
        W = np.zeros((len(names), K))
        params = [W, self.step, self.first, self.last]
        first_moment = [np.zeros_like(p) for p in params]
        second_moment = [np.zeros_like(p) for p in params]
        for turn in range(1, rounds + 1):
            E = np.zeros((n * longest, K))
            for k in range(K):
                E[:, k] = np.bincount(owner, W[feature, k], n * longest)
            E = E.reshape(n, longest, K)
            ahead = np.zeros((n, longest, K))
            ahead[:, 0] = E[:, 0] + self.first
            for t in range(1, longest):
                ahead[:, t] = E[:, t] + _logsumexp(ahead[:, t - 1, :, None] + self.step, 1)
            whole = _logsumexp(ahead[rows, lengths - 1] + self.last, 1)
            back = np.zeros((n, longest, K))
            back[rows, lengths - 1] = self.last
            pairs = np.zeros((K, K))
            seen = np.zeros((K, K))
            for t in range(longest - 2, -1, -1):
                live = np.flatnonzero(t + 1 < lengths)
                onward = self.step + (E[live, t + 1] + back[live, t + 1])[:, None, :]
                back[live, t] = _logsumexp(onward, 2)
                joint = ahead[live, t, :, None] + onward - whole[live, None, None]
                pairs += np.exp(joint).sum(axis=0)
                np.add.at(seen, (gold[live, t], gold[live, t + 1]), 1)
            marginal = np.exp(ahead + back - whole[:, None, None]) * there[:, :, None]
            error = (truth - marginal).reshape(-1, K)
            up = [
                np.stack(
                    [np.bincount(feature, error[owner, k], len(names)) for k in range(K)], axis=1
                ),
                seen - pairs,
                (truth - marginal)[:, 0].sum(axis=0),
                (truth - marginal)[rows, lengths - 1].sum(axis=0),
            ]
            for p, g, m, v in zip(params, up, first_moment, second_moment):
                g = g / n - penalty / n * p
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        self.scores = {f: tuple(W[i].tolist()) for f, i in names.items()}
        return self

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The best labels of one sequence."""
        labels = range(self.labels)
        none = (0.0,) * self.labels
        step, scores = self.step.tolist(), self.scores
        best, chosen = None, []
        for features in sequence:
            own = [0.0] * self.labels
            for f in features:
                for k, x in enumerate(scores.get(f, none)):
                    own[k] += x
            if best is None:
                best = [own[k] + self.first[k] for k in labels]
                continue
            origin = [max(labels, key=lambda j: best[j] + step[j][k]) for k in labels]
            best = [best[j] + step[j][k] + own[k] for k, j in enumerate(origin)]
            chosen.append(origin)
        if best is None:
            return []
        path = [max(labels, key=lambda k: best[k] + self.last[k])]
        for origin in reversed(chosen):
            path.append(origin[path[-1]])
        return path[::-1]
