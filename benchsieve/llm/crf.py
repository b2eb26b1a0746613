"""A small linear-chain conditional random field in numpy."""

from __future__ import annotations

import numpy as np


class Crf:
    """Emission weights (features x labels), transitions and start weights."""

    def __init__(self, n_features: int, n_labels: int) -> None:
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def fit(self, seqs: list[np.ndarray], tags: list[np.ndarray], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Crf:
        """Adam on the conditional log likelihood, with an L2 penalty on leaving the weights it starts from; all sequences at once, padded."""
        n, t = len(seqs), max(len(s) for s in seqs)
        f, k = self.emit.shape
        x = np.zeros((n, t, f))
        y = np.zeros((n, t), dtype=int)
        on = np.zeros((n, t), dtype=bool)
        for i, (s, g) in enumerate(zip(seqs, tags)):
            x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, g, True
        gold = np.eye(k)[y] * on[..., None]
        pairs = on[:, 1:]
        gold_move = np.einsum("nti,ntj,nt->ij", gold[:, :-1], gold[:, 1:], pairs)
        theta = [self.emit, self.move, self.first]
        start = [p.copy() for p in theta]
        mean = [np.zeros_like(p) for p in theta]
        var = [np.zeros_like(p) for p in theta]
        for step in range(1, rounds + 1):
            e = x @ self.emit
            e[:, 0] += self.first
            a = np.empty((n, t, k))
            b = np.zeros((n, t, k))
            a[:, 0] = e[:, 0]
            for j in range(1, t):
                new = e[:, j] + _lse(a[:, j - 1][:, :, None] + self.move, 1)
                a[:, j] = np.where(on[:, j][:, None], new, a[:, j - 1])
            for j in range(t - 2, -1, -1):
                new = _lse(self.move + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2)
                b[:, j] = np.where(on[:, j + 1][:, None], new, b[:, j + 1] * 0)
            z = _lse(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * on[..., None]
            g_emit = np.einsum("ntf,ntk->fk", x, p - gold) / n + decay * (self.emit - start[0])
            q = np.exp(a[:, :-1, :, None] + self.move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
            g_move = ((q * pairs[..., None, None]).sum((0, 1)) - gold_move) / n + decay * (self.move - start[1])
            g_first = (p[:, 0] - gold[:, 0]).sum(0) / n + decay * (self.first - start[2])
            for i, g in enumerate((g_emit, g_move, g_first)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                var[i] = 0.99 * var[i] + 0.01 * g * g
                theta[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def tag(self, s: np.ndarray) -> list[int]:
        """The best label sequence (Viterbi)."""
        return self.tag_all(s, [len(s)])[0]

    def tag_all(self, rows: np.ndarray, lengths: list[int]) -> list[list[int]]:
        """The best label sequences of many texts, whose rows stand one after the other; an empty text has no labels.

        Few labels and short texts: plain lists beat arrays here.
        """
        emitted = (rows @ self.emit).tolist()
        move, first = self.move.T.tolist(), self.first.tolist()
        labels = range(len(first))
        out: list[list[int]] = []
        at = 0
        for n in lengths:
            if not n:
                out.append([])
                continue
            best = [a + b for a, b in zip(emitted[at], first)]
            back: list[list[int]] = []
            for row in emitted[at + 1 : at + n]:
                came, new = [], []
                for k in labels:
                    c = [a + b for a, b in zip(best, move[k])]
                    top = max(c)
                    came.append(c.index(top))
                    new.append(top + row[k])
                back.append(came)
                best = new
            at += n
            tags = [best.index(max(best))]
            for came in reversed(back):
                tags.append(came[tags[-1]])
            out.append(tags[::-1])
        return out


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)
