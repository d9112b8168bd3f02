"""Logistic regression on small, bounded training sets, and calibration of scores."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_sparse(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights of ``width`` columns and a bias, by accelerated gradient descent on the penalised log loss.

    The matrix is given by its non-zero cells. The penalty leaves the bias alone.
    """
    n = max(1, len(y))
    w, prior = np.zeros(width + 1), float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    w[-1] = np.log(prior / (1 - prior))
    # a bound of the curvature: power iteration for the largest singular value of the matrix with a column of ones
    v = np.ones(width + 1) / np.sqrt(width + 1)
    top = 1.0
    for _ in range(12):
        u = np.bincount(rows, values * v[columns], len(y)) + v[-1]
        v = np.append(np.bincount(columns, values * u[rows], width), u.sum())
        top = max(float(np.linalg.norm(v)), 1e-12)
        v /= top
    rate = 1 / (0.25 * top * 1.1 + penalty)
    ahead, last, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        p = sigmoid(np.bincount(rows, values * ahead[columns], len(y)) + ahead[-1])
        g = np.append(np.bincount(columns, values * (p - y)[rows], width) + penalty * ahead[:-1], (p - y).sum())
        w = ahead - rate * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, last, t = w + (t - 1) / t2 * (w - last), w, t2
        if np.abs(g).max() < 1e-5 * n:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Dense weights and a bias, by Newton steps."""
    one = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(one.shape[1])
    keep = np.diag(np.append(np.full(x.shape[1], penalty), 1e-6))
    for _ in range(steps):
        p = sigmoid(one @ w)
        g = one.T @ (p - y) + keep @ w
        h = (one * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ one + keep
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn raw scores into log odds."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    a, b = fit(scores[:, None], y, penalty=1e-3)
    return float(a), float(b)
