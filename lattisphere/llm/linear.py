"""A linear hinge-loss model fitted by dual coordinate descent (Hsieh et al., 2008), and a logistic scale for its margins."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: np.ndarray, rounds: int = 20, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights w (the last one is the bias) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y w x). rows: sparse (indices, values); y: 1 or -1."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for _, v in rows])
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        random.shuffle(order)
        for i in order:
            at, values = rows[i]
            gradient = y[i] * (float(w[at] @ values) + w[dim]) - 1.0
            if alpha[i] == 0:
                pull = min(gradient, 0.0)
            elif alpha[i] >= cost[i]:
                pull = max(gradient, 0.0)
            else:
                pull = gradient
            worst = max(worst, abs(pull))
            if pull:
                old = alpha[i]
                alpha[i] = min(max(old - gradient / diagonal[i], 0.0), cost[i])
                step = (alpha[i] - old) * y[i]
                w[at] += step * values
                w[dim] += step
        if worst < tolerance:
            break
    return w


def fit_scale(margins: np.ndarray, y: np.ndarray) -> float:
    """The slope a > 0 for which 1 / (1 + exp(-a * margin)) suits the labels best, by Newton steps; the margin's sign keeps its meaning."""
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins, -30, 30)))
        gradient = float(((p - (y > 0)) * margins).mean()) + 1e-3 * a
        bend = float((p * (1 - p) * margins**2).mean()) + 1e-3
        a = min(max(a - gradient / bend, 0.05), 20.0)
    return a


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
