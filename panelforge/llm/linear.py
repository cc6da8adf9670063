"""Linear support vector machines and logistic fits on a bounded sample, in NumPy."""

from __future__ import annotations

import math

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120, balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + c * mean of squared hinge losses; y is -1 or 1.

    Accelerated gradient steps of the length that the largest curvature allows.  With
    `balance` both classes weigh the same.
    """
    n = len(y)
    y = y.astype(x.dtype)
    weight = np.full(n, 1.0 / n, x.dtype)
    if balance:
        for side in (-1, 1):
            at = y == side
            weight[at] = 0.5 / max(1, at.sum())
    v = np.full(x.shape[1], 1 / math.sqrt(max(1, x.shape[1])), x.dtype)
    for _ in range(30):
        v = x.T @ (weight * (x @ v)) + 1e-12
        size = float(np.linalg.norm(v))
        v /= size
    step = 1.0 / (1.0 + 2 * c * (size + 1.0) * 1.1)
    # Plain numbers beside the arrays, so that these keep their type.
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ pw + pb))
        g = -2 * c * weight * y * slack
        nw, nb = pw - step * (pw + x.T @ g), pb - step * float(g.sum())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def logistic(x: np.ndarray, weight: np.ndarray | None = None, y: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton's method for the mean loss log(1 + exp(-y x.w)) + ridge |w|^2 / 2."""
    y = np.ones(len(x)) if y is None else y
    weight = np.full(len(x), 1.0 / max(1, len(x))) if weight is None else weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(-y * (x @ w))
        grad = ridge * w - x.T @ (weight * y * p)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, grad)
        size = np.linalg.norm(move)
        w = w - move * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
