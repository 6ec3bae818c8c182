"""A linear-chain conditional random field in numpy: training, and Viterbi over many sequences at once."""

from __future__ import annotations

import numpy as np


class Crf:
    """Labels 0..L-1; a token has F features, one of each of F tables, given as row numbers."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.emission, self.transition, self.start = emission, transition, start

    @staticmethod
    def trained(sequences: list[tuple[np.ndarray, np.ndarray]], rows: int, labels: int, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Crf:
        """Gradient ascent (Adagrad) on the log-likelihood of (features n x F, labels n) sequences."""
        w, t, s = np.zeros((rows, labels)), np.zeros((labels, labels)), np.zeros(labels)
        squares = [np.full_like(x, 1e-6) for x in (w, t, s)]
        for _ in range(rounds):
            for f, y in sequences:
                n = len(y)
                score = w[f].sum(1)
                a, b = np.empty((n, labels)), np.zeros((n, labels))
                a[0] = s + score[0]
                for i in range(1, n):
                    a[i] = score[i] + _lse(a[i - 1][:, None] + t, 0)
                for i in range(n - 2, -1, -1):
                    b[i] = _lse(t + (score[i + 1] + b[i + 1])[None, :], 1)
                z = _lse(a[-1], 0)
                p = np.exp(a + b - z)
                g = np.eye(labels)[y] - p
                gw, gt, gs = np.zeros_like(w), np.zeros_like(t), g[0].copy()
                for k in range(f.shape[1]):
                    np.add.at(gw, f[:, k], g)
                for i in range(1, n):
                    gt -= np.exp(a[i - 1][:, None] + t + (score[i] + b[i])[None, :] - z)
                    gt[y[i - 1], y[i]] += 1
                for x, gx, q in zip((w, t, s), (gw, gt, gs), squares, strict=True):
                    gx -= decay * x
                    q += gx * gx
                    x += rate * gx / np.sqrt(q)
        return Crf(w, t, s)

    def decoded(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of joined sequences (tokens x F, lengths), all sequences step by step together."""
        labels = len(self.start)
        score = self.emission[features].sum(1)
        begin = np.cumsum(lengths) - lengths
        by = np.argsort(-lengths, kind="stable")
        begin, lengths = begin[by], lengths[by]
        out = np.zeros(len(features), np.int8)
        if not len(lengths) or not lengths[0]:
            return out
        back = np.zeros((len(features), labels), np.int8)
        now = np.empty((len(lengths), labels))
        for step in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -step, "left"))  # sequences longer than step
            if not step:
                now[:n] = self.start + score[begin[:n]]
                continue
            paths = now[:n, :, None] + self.transition
            best = paths.argmax(1)
            back[begin[:n] + step] = best
            now[:n] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + score[begin[:n] + step]
        n = int(np.searchsorted(-lengths, 0, "left"))
        label = now[:n].argmax(1)
        for step in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -step, "left"))
            at = begin[:n] + step
            out[at] = label[:n]
            label[:n] = np.where(step > 0, back[at, label[:n]], label[:n])
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))
