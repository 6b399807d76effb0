"""A linear-chain conditional random field over two labels, out (0) and span (1), in numpy, many sequences at once."""

from __future__ import annotations

import numpy as np


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(sequences by falling length, start of each in that order, number of sequences still running at each step)."""
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    ls = lengths[order]
    running = [] if not len(ls) else (len(ls) - np.searchsorted(ls[::-1], np.arange(int(ls[0])), side="right")).tolist()
    return order, start, running


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class Chain:
    """Potentials: node[t] for label 1 (0 for label 0) and edge[a, b] from label a to b. Sequences lie end to end."""

    def __init__(self, node: np.ndarray, lengths: np.ndarray, edge: np.ndarray) -> None:
        self.node, self.lengths, self.edge = node, lengths, edge
        self.order, self.start, self.running = _layout(lengths)

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """(log alpha of each token and label, log Z of each sequence)."""
        alpha, e = np.zeros((len(self.node), 2)), self.edge
        for step, k in enumerate(self.running):
            at = self.start[:k] + step
            if step == 0:
                alpha[at, 1] = self.node[at]
                continue
            a0, a1 = alpha[at - 1, 0], alpha[at - 1, 1]
            alpha[at, 0] = _log_add(a0 + e[0, 0], a1 + e[1, 0])
            alpha[at, 1] = self.node[at] + _log_add(a0 + e[0, 1], a1 + e[1, 1])
        z = np.zeros(len(self.lengths))
        end = (np.cumsum(self.lengths) - 1)[self.lengths > 0]
        z[self.lengths > 0] = _log_add(alpha[end, 0], alpha[end, 1])
        return alpha, z

    def marginals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of label 1 of each token, expected count of each edge summed over all, log Z)."""
        alpha, z = self.forward()
        e, beta = self.edge, np.zeros((len(self.node), 2))
        pairs = np.zeros((2, 2))
        zs = z[self.order]
        for step in range(len(self.running) - 1, 0, -1):
            k = self.running[step]
            at = self.start[:k] + step
            b0, b1 = beta[at, 0], self.node[at] + beta[at, 1]
            for a in (0, 1):
                for b, v in ((0, b0), (1, b1)):
                    pairs[a, b] += np.exp(alpha[at - 1, a] + e[a, b] + v - zs[:k]).sum()
            beta[at - 1, 0] = _log_add(e[0, 0] + b0, e[0, 1] + b1)
            beta[at - 1, 1] = _log_add(e[1, 0] + b0, e[1, 1] + b1)
        return np.exp(alpha[:, 1] + beta[:, 1] - np.repeat(z, self.lengths)), pairs, z


class CRF:
    """Weights of hashed features for label 1, and of the edges. A token has the same number of features each."""

    def __init__(self, size: int) -> None:
        self.w, self.edge = np.zeros(size, np.float32), np.zeros((2, 2))

    def chain(self, features: np.ndarray, lengths: np.ndarray) -> Chain:
        return Chain(self.w[features].sum(axis=1, dtype=np.float64), lengths, self.edge)

    def fit(self, features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 2e-5, batch: int = 1024, seed: int = 7) -> None:
        """Adagrad on the weighted log-likelihood; labels by token, weight by sequence."""
        rng = np.random.default_rng(seed)
        begin = np.cumsum(lengths) - lengths
        sum_w, sum_e = np.full(len(self.w), 1e-6, np.float64), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            perm = rng.permutation(len(lengths))
            for lo in range(0, len(perm), batch):
                s = perm[lo : lo + batch]
                n = lengths[s]
                end = np.cumsum(n)
                t = np.arange(int(end[-1])) + np.repeat(begin[s] - (end - n), n)
                x, y, g = features[t], labels[t].astype(np.float64), np.repeat(weight[s], n)
                p, pairs, _ = self.chain(x, n).marginals()
                grad = np.bincount(x.ravel(), np.repeat((y - p) * g, x.shape[1]), len(self.w)) - decay * len(s) * self.w
                hit = np.flatnonzero(grad)
                sum_w[hit] += grad[hit] ** 2
                self.w[hit] += (rate * grad[hit] / np.sqrt(sum_w[hit])).astype(np.float32)
                inner = np.ones(len(t), bool)
                inner[end[n > 0] - n[n > 0]] = False
                i = np.flatnonzero(inner)
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[t][i - 1].astype(int), labels[t][i].astype(int)), 1.0)
                ge = seen - pairs - decay * len(s) * self.edge
                sum_e += ge**2
                self.edge += rate * ge / np.sqrt(sum_e)
