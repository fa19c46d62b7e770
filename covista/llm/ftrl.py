"""Follow-the-regularised-leader (FTRL-proximal, McMahan and others 2013) for logistic regression over
hashed features."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Per-coordinate online learner; ``weights`` are zero where |z| stays within ``l1``."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 1e-3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> float:
        """One example: distinct features ``at`` with values ``x``; returns the score before learning."""
        w = self.weights(at)
        p = float(sigmoid(w @ x))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 0) -> Ftrl:
        """Passes over the examples, each in its own fixed order."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.learn(*examples[i])
        return self
