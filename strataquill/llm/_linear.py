"""Logistic regression on sparse rows (numpy, on the driver, over samples of bounded size)."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, penalty: float = 1e-4, rounds: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) for soft targets in [0, 1] by full-batch Adam.

    Entry i says that row[i] has value[i] in column[i]; rows weigh ``weight``. With no rows, or one kind of target only,
    weights are zero and the bias is the targets' mean as log-odds.
    """
    w = np.zeros(width)
    total = weight.sum()
    if not total:
        return w, 0.0
    mean = float(np.clip((target * weight).sum() / total, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    if target.min() == target.max():
        return w, bias
    used, column = np.unique(column, return_inverse=True)
    v = np.zeros(len(used) + 1)
    v[-1] = bias
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    n = len(target)
    for i in range(1, rounds + 1):
        z = np.bincount(row, value * v[:-1][column], minlength=n) + v[-1]
        d = (sigmoid(z) - target) * weight / total
        g = np.append(np.bincount(column, value * d[row], minlength=len(used)) + penalty * v[:-1], d.sum())
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g * g - m2)
        v -= rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-9)
    w[used] = v[:-1]
    return w, float(v[-1])
