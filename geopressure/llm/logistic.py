"""A small logistic regression for bounded samples of feature rows."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardised features, L2 penalty, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None) -> None:
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = x.std(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self._design(x)
        w = np.ones(len(x)) if weight is None else weight
        self.beta = np.zeros(z.shape[1])
        share = (w @ y + 0.5) / (w.sum() + 1.0)
        self.beta[0] = np.log(share / (1 - share))
        if len(x) == 0 or y.min() == y.max():
            return
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (w * (p - y)) + ridge * self.beta
            curve = (z.T * (w * p * (1 - p))) @ z + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            self.beta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(np.asarray(x, float)) @ self.beta, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))
