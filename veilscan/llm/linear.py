"""Linear models on hashed features: follow-the-regularised-leader updates over a bounded sample, and scoring by sparse dot products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of the updates. The bias has no penalty."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 4


class FtrlModel:
    """Logistic regression on sparse rows (feature numbers, values) with a few dense features behind them."""

    def __init__(self, size: int, dense: int = 0, settings: Ftrl = Ftrl()):
        self.settings = settings
        self.z = np.zeros(size + dense + 1)
        self.n = np.zeros(size + dense + 1)
        self.size, self.dense = size, dense

    def _weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.settings, self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def weights(self) -> np.ndarray:
        """Of all features, then the dense ones, then the bias."""
        return self._weights(np.arange(len(self.z)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, extra: np.ndarray | None = None, seed: int = 5) -> FtrlModel:
        """Passes over the rows in an order drawn from the seed; extra holds the dense features, a line per row."""
        order = np.random.default_rng(seed)
        tail = np.arange(self.size, self.size + self.dense + 1)
        ends = np.ones((len(rows), self.dense + 1))
        if self.dense:
            ends[:, :-1] = extra
        for _ in range(self.settings.epochs):
            for i in order.permutation(len(rows)):
                at, value = np.concatenate([rows[i][0], tail]), np.concatenate([rows[i][1], ends[i]])
                w = self._weights(at)
                g = (sigmoid(float(w @ value)) - labels[i]) * value
                squares = g * g
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + squares) - np.sqrt(n)) / self.settings.alpha * w
                self.n[at] = n + squares
        return self


def dots(weights: np.ndarray, features: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sparse dot product of each row with the weights."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(rows, weights=weights[features] * values, minlength=len(bounds) - 1)
