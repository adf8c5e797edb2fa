"""Multinomial logistic regression on a small table, dense or sparse, on the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """A matrix of zeros and ones: for each row the sorted columns that hold a one."""

    def __init__(self, rows: list[list[int]], width: int):
        self.shape = (len(rows), width)
        self.columns = np.array([c for r in rows for c in r], np.int64)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.by_column = np.argsort(self.columns, kind="stable")

    def __len__(self) -> int:
        return self.shape[0]

    @staticmethod
    def _sums(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows of values with equal keys; keys are sorted."""
        out = np.zeros((size, values.shape[1]))
        if len(keys):
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out[keys[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.columns], self.rows, self.shape[0])

    def transposed_times(self, gap: np.ndarray) -> np.ndarray:
        return self._sums(gap[self.rows[self.by_column]], self.columns[self.by_column], self.shape[1])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray | Sparse, y: np.ndarray, classes: int, ridge: float = 1e-3, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts that minimise the mean log loss with a ridge penalty; every step uses all
    rows, so that the result depends on nothing but the table."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        gap = (softmax(x @ w + b) - target) / len(x)
        for k, (g, v) in enumerate((((x.transposed_times(gap) if isinstance(x, Sparse) else x.T @ gap) + ridge * w, w), (gap.sum(axis=0), b))):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w, b


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The number by which to divide held-out scores z so that the log loss of y is least (calibration)."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()))
