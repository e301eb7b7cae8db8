"""k-means on a bounded sample: k-means++ start, Lloyd steps. Training sees at most SAMPLE vectors; assignment sees all."""

from __future__ import annotations

import numpy as np

ITERATIONS, SAMPLE, SEED = 30, 100_000, 42
#: Rows of one matrix product.
ROWS = 4096


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The first of the best centroids of each row."""
    c = np.asarray(centroids, np.float64)
    norm = np.sqrt((c * c).sum(1))
    if metric == "cosine":
        c = c / np.where(norm > 0, norm, 1)[:, None]
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), ROWS):  # what all centroids have alike doesn't count
        s = np.asarray(x[lo : lo + ROWS], np.float64) @ c.T
        if metric == "euclidean":
            s -= norm * norm / 2
        out[lo : lo + ROWS] = s.argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, metric: str = "euclidean", iterations: int = ITERATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and assignment. Empty clusters keep their centroid; with fewer distinct points than k, the rest are zeros."""
    x = np.asarray(x, np.float64)
    rng = np.random.default_rng(seed)
    c = np.zeros((k, x.shape[1]))
    if not len(x) or not k:
        return c, np.zeros(len(x), np.int64)
    c[0] = x[rng.integers(len(x))]
    far = ((x - c[0]) ** 2).sum(1)
    filled = 1
    while filled < min(k, len(x)) and far.sum() > 0:
        c[filled] = x[rng.choice(len(x), p=far / far.sum())]
        far = np.minimum(far, ((x - c[filled]) ** 2).sum(1))
        filled += 1
    who = np.full(len(x), -1)
    for _ in range(iterations):
        new = nearest(x, c[:filled], metric)
        if (new == who).all():
            break
        who = new
        n = np.bincount(who, minlength=filled)
        sums = np.stack([np.bincount(who, column, filled) for column in x.T], 1)
        c[:filled][n > 0] = sums[n > 0] / n[n > 0, None]
    return c, who
