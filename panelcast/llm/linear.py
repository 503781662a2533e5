"""Small dense-free learners for a bounded sample: NumPy on compressed rows."""

from __future__ import annotations

import numpy as np

CHUNK = 500_000  # entries at once: the temporaries stay small beside the rows


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(z, -60, 60)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, weight: np.ndarray,
                 n_features: int, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on weighted sparse rows, by Nesterov gradient descent
    with per-feature step sizes (a diagonal bound of the Hessian)."""
    n = len(y)
    w, b = np.zeros(n_features), 0.0
    if n == 0:
        return w, b

    def by_row(of_cols: np.ndarray | None, magnitude: bool = False) -> np.ndarray:
        """Sum over a row's entries of value (or its magnitude) times the column's number, a chunk at a time."""
        out = np.zeros(n)
        for k in range(0, len(rows), CHUNK):
            v = np.abs(vals[k:k + CHUNK]) if magnitude else vals[k:k + CHUNK]
            out += np.bincount(rows[k:k + CHUNK], v if of_cols is None else v * of_cols[cols[k:k + CHUNK]], n)
        return out

    def by_col(of_rows: np.ndarray, magnitude: bool = False) -> np.ndarray:
        out = np.zeros(n_features)
        for k in range(0, len(rows), CHUNK):
            v = np.abs(vals[k:k + CHUNK]) if magnitude else vals[k:k + CHUNK]
            out += np.bincount(cols[k:k + CHUNK], v * of_rows[rows[k:k + CHUNK]], n_features)
        return out

    base = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    b = float(np.log(base / (1 - base)))
    width = by_row(None, magnitude=True) + 1.0
    step = 1.0 / (0.25 * by_col(width * weight, magnitude=True) + l2)
    step_b = 1.0 / (0.25 * (width * weight).sum())
    prev, prev_b, t = w.copy(), b, 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        look, look_b = w + m * (w - prev), b + m * (b - prev_b)
        prev, prev_b, t = w, b, t2
        err = weight * (sigmoid(by_row(look) + look_b) - y)
        w = look - step * (by_col(err) + l2 * look)
        b = look_b - step_b * err.sum()
    return w, float(b)
