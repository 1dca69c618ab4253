"""A logistic regression for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, for labels from 0 to 1, by damped Newton steps with a ridge on all but the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = np.clip((x @ w.astype(x.dtype)).astype(float), -35, 35)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = sigmoid((x @ w.astype(x.dtype)).astype(float))  # no wide copy of x
        slope = x.T @ (weight * (p - y)).astype(x.dtype) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6)).astype(x.dtype)[:, None]).T @ x
        step = np.linalg.solve(curve.astype(float) + np.diag(penalty + 1e-9), slope)
        rate = 1.0
        while rate > 1e-4 and (then := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-4 or now - then < 1e-7 * max(1.0, abs(now)):
            break
        w, now = w - rate * step, then
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept that turn a classifier's logits into calibrated ones, as Platt does."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([1.0, 0.0])
    n1 = y.sum()
    soft = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    return fit_logistic(z[:, None], soft, ridge=1e-3)
