"""Small linear models trained with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _dot(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A product in the matrix's own precision, so that it isn't copied."""
    return (x @ v.astype(x.dtype)).astype(np.float64)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, dual coordinate descent); y is +1 or -1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    balance = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    soft = np.array([1 / (2 * c * balance[s]) for s in y])
    diag = (x * x).sum(axis=1) + soft
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]) * diag[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Logistic regression; y is 0 or 1, both classes weigh the same. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, adam = np.zeros(x.shape[1]), _Adam(x.shape[1], rate)
    for _ in range(steps):
        miss = weight * (sigmoid(_dot(x, w)) - y)
        w = adam.step(w, _dot(x.T, miss) + l2 * np.append(w[:-1], 0))
    return w


def convex_pu(p: np.ndarray, u: np.ndarray, prior: float, l2: float, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of 0 or more, and a bias, that make the positive-unlabelled risk with the logistic loss least; the last column is all ones.

    The logistic losses of a row as positive and as negative differ by its margin, so the risk is the mean of log(1 + exp(margin)) over
    the unlabelled rows less ``prior`` times the mean margin of the positives. That is convex: the start doesn't decide what is found.
    """
    w, adam = np.zeros(p.shape[1]), _Adam(p.shape[1], rate)
    w[-1] = np.log(prior / (1 - prior))
    pull = prior * p.mean(axis=0, dtype=np.float64)
    for _ in range(steps):
        w = adam.step(w, _dot(u.T, sigmoid(_dot(u, w))) / len(u) - pull + l2 * np.append(w[:-1], 0))
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-4, epochs: int = 60, batches: int = 8, rate: float = 0.05, seed: int = 0) -> np.ndarray:
    """Non-negative positive-unlabelled learning with the sigmoid loss; the last weight is the bias.

    The risk of negatives is that of the unlabelled rows less ``prior`` times that of the positives scored as negatives. Where a
    batch makes it negative, which the true risk can't be, the step goes up that part instead of down the whole. Weights stay at 0 or
    above: the features are evidence for the positive class, and the absence of other evidence is the bias. The sigmoid loss isn't
    convex, and from weights of 0 only a feature that alone makes a row likelier positive than not would ever rise, so the steps start
    at the minimum of the convex risk. Without positive or unlabelled rows nothing is known but the prior.
    """
    if not len(positive) or not len(unlabelled):
        return np.append(np.zeros(positive.shape[1]), np.log(prior / (1 - prior)))
    p = np.hstack([positive, np.ones((len(positive), 1), positive.dtype)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), unlabelled.dtype)])
    w, adam, rng = convex_pu(p, u, prior, l2), _Adam(p.shape[1], rate), np.random.default_rng(seed)
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            if not len(pi) or not len(ui):
                continue
            pb, ub = p[pi], u[ui]
            sp, su = sigmoid(_dot(pb, w)), sigmoid(_dot(ub, w))  # loss of a row as negative; as positive it is 1 - s
            dp, du = _dot(pb.T, sp * (1 - sp)) / len(pi), _dot(ub.T, su * (1 - su)) / len(ui)
            negative = du - prior * dp
            g = -prior * dp + negative if su.mean() - prior * sp.mean() >= 0 else -negative
            w = adam.step(w, g + l2 * np.append(w[:-1], 0))
            w[:-1] = np.maximum(w[:-1], 0)
    return w
