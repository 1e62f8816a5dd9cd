"""Sparse linear models over hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: ``index[start[i]:start[i + 1]]`` are the features of row ``i``, ``value`` their values."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.start = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        self.index = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate(values).astype(np.float32) if values else np.ones(len(self.index), np.float32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.start))
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index] * self.value, self.n)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.index, g[self.row] * self.value, dims)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_logistic(x: Rows, target: np.ndarray, dims: int, l2: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets in 0..1."""
    w, b, opt = np.zeros(dims), 0.0, Adam(dims + 1, rate)
    for _ in range(rounds if x.n else 0):
        g = (sigmoid(x.dot(w) + b) - target) / x.n
        step = opt.step(np.r_[x.back(g, dims) + l2 * w, g.sum()])
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit_cumulative(x: Rows, grade: np.ndarray, grades: int, dims: int, l2: float = 1e-4, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link (proportional odds) regression: ``P(y <= k) = sigmoid(theta_k - w.x)``.

    One weight vector is shared by all grades; thresholds stay ordered, as the first is free and the
    others add positive steps. Returns the weights and the ``grades - 1`` thresholds.
    """
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(len(grade), 1), 0.01, 0.99)
    theta0 = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    free = np.r_[theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-3))]
    w, opt = np.zeros(dims), Adam(dims + grades - 1, rate)
    thresholds = lambda f: f[0] + np.r_[0, np.cumsum(np.exp(f[1:]))]
    for _ in range(rounds if x.n else 0):
        theta = thresholds(free)
        f = x.dot(w)
        edge = np.r_[-np.inf, theta, np.inf]
        upper, lower = sigmoid(edge[grade + 1] - f), sigmoid(edge[grade] - f)
        upper[grade == grades - 1], lower[grade == 0] = 1, 0
        p = np.maximum(upper - lower, 1e-9)
        df = (1 - upper - lower) / x.n  # of the negative log likelihood
        dtheta = np.bincount(grade, -upper * (1 - upper) / p, grades)[:-1] + np.bincount(grade, lower * (1 - lower) / p, grades)[1:]
        dtheta /= x.n
        dfree = np.r_[dtheta.sum(), [dtheta[k:].sum() * np.exp(free[k]) for k in range(1, grades - 1)]]
        step = opt.step(np.r_[x.back(df, dims) + l2 * w, dfree])
        w, free = w - step[:dims], free - step[dims:]
    return w, thresholds(free)
