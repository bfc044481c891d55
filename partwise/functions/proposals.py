"""Next parameter sets from a cluster's own trial history (a handful of rows)."""

from __future__ import annotations

import numpy as np

KERNELS = ["rbf", "linear", "poly", "sigmoid"]


def encode(c, gamma, kernel, epsilon, space) -> np.ndarray:
    """Unit-cube coordinates; the kernel is one-hot."""
    unit = lambda v, lo, hi: (np.log(v) - np.log(lo)) / (np.log(hi) - np.log(lo))
    hot = np.array([[k == name for name in KERNELS] for k in kernel], dtype=float)
    return np.column_stack([unit(np.asarray(c), *space["c"]), unit(np.asarray(gamma), *space["gamma"]), np.asarray(epsilon), hot])


def draw(rng: np.random.Generator, n: int, space) -> dict:
    spread = lambda lo, hi: np.exp(rng.uniform(np.log(lo), np.log(hi), n))
    return {"c": spread(*space["c"]), "gamma": spread(*space["gamma"]), "epsilon": rng.uniform(0, 1, n),
            "kernel": [KERNELS[i] for i in rng.integers(0, len(KERNELS), n)]}


def _gauss(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (2 * scale ** 2))


def by_gaussian_process(seen: np.ndarray, score: np.ndarray, pool: np.ndarray) -> int:
    """Pool entry of largest expected improvement under a Gaussian process."""
    mean, scale = score.mean(), score.std() or 1.0
    y = (score - mean) / scale
    chol = np.linalg.cholesky(_gauss(seen, seen, 0.5) + 1e-4 * np.eye(len(seen)))
    cross = _gauss(pool, seen, 0.5)
    alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, y))
    mu = cross @ alpha
    half = np.linalg.solve(chol, cross.T)
    sd = np.sqrt(np.maximum(1e-12, 1.0 - (half ** 2).sum(0)))
    z = (mu - y.max()) / sd
    cdf = 0.5 * (1 + _erf(z / np.sqrt(2)))
    gain = (mu - y.max()) * cdf + sd * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    return int(gain.argmax())


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, error below 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def by_parzen_ratio(seen: np.ndarray, score: np.ndarray, pool: np.ndarray, good_share: float = 0.25) -> int:
    """Pool entry with the largest density ratio of good to other trials."""
    order = np.argsort(-score, kind="stable")
    n_good = max(1, int(np.ceil(good_share * len(score))))
    good, rest = seen[order[:n_good]], seen[order[n_good:]]
    low = _gauss(pool, rest, 0.3).mean(1) if len(rest) else np.ones(len(pool))
    return int(((_gauss(pool, good, 0.3).mean(1) + 1e-9) / (low + 1e-9)).argmax())
