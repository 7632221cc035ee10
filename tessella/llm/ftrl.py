"""Logistic regression on sparse hashed features by follow-the-regularised-leader (FTRL-proximal) updates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """z and n are the usual per-feature sums; the last slot is the bias, which isn't regularised."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, features: Sequence[np.ndarray], values: Sequence[np.ndarray], labels: np.ndarray, epochs: int = 4, seed: int = 7, weights: np.ndarray | None = None) -> Ftrl:
        """Each example: distinct feature indices and their values. Examples are taken in a seeded order."""
        order, rng = np.arange(len(labels)), np.random.default_rng(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                i, x = features[k], values[k]
                z, n = self.z[i], self.n[i]
                w = self._weights(z, n, self.l1)
                bias = self._weights(self.z[-1:], self.n[-1:], 0.0)[0]
                error = sigmoid(w @ x + bias) - labels[k]
                if weights is not None:
                    error *= weights[k]
                g = error * x
                after = n + g * g
                self.z[i] = z + g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
                self.n[i] = after
                was = self.n[-1]
                self.n[-1] += error * error
                self.z[-1] += error - (np.sqrt(self.n[-1]) - np.sqrt(was)) / self.alpha * bias
        return self

    def finished(self) -> tuple[np.ndarray, float]:
        """Dense weights and the bias."""
        return self._weights(self.z[:-1], self.n[:-1], self.l1).astype(np.float32), float(self._weights(self.z[-1:], self.n[-1:], 0.0)[0])


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """A fold for each id, by a multiplicative hash."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
