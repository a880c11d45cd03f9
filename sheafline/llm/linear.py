"""Linear support vector machines and calibration for models fitted on the driver."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM; ``y`` is -1 or 1, and both classes weigh the same.

    Accelerated full-batch gradient steps from zero: the same data give the same
    model. ``x`` is not copied; the bias is a further column of ones in all but memory.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    forth = lambda w: x @ w[:-1] + w[-1]
    back = lambda r: np.append(r @ x, r.sum()).astype(x.dtype)
    probe = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(12):  # largest curvature, by power iteration
        probe = back(weight * forth(probe))
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    ridge = 1e-3 / cost
    step = 1 / (2 * top + ridge)
    w = past = np.zeros(x.shape[1] + 1, x.dtype)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - past)
        slack = np.maximum(0, 1 - y * forth(ahead))
        past, w = w, ahead - step * (ridge * ahead - 2 * back(weight * y * slack))
    return w[:-1], float(w[-1])


def train_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of a logistic regression on a few columns, by Newton steps."""
    x = np.hstack([np.asarray(x, np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        change = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), grad)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
