"""Least squares without SciPy: bounded Levenberg-Marquardt and non-negative least squares."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200, guess: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 of least |a x - b|, by an active set on the normal equations; ``guess`` (columns likely above 0) is tried first."""
    return nnls_normal(a.T @ a, a.T @ b, rounds, guess)


def _solved(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solution of symmetric equations; of least norm where they are singular."""
    try:
        s = np.linalg.solve(g, c)
        if np.abs(g @ s - c).max() <= 1e-9 * np.abs(c).max() and np.abs(s).max() <= 1e9 * np.abs(c).max():
            return s
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(g, c, rcond=None)[0]


def nnls_normal(g: np.ndarray, c: np.ndarray, rounds: int = 200, guess: np.ndarray | None = None) -> np.ndarray:
    """As ``nnls``, from the normal equations a'a = g, a'b = c."""
    scale = np.sqrt(np.diag(g))
    scale[scale == 0] = 1
    g, c = g / (scale[:, None] * scale), c / scale
    n = len(c)
    least = 1e-9 * max(1.0, np.abs(c).max())
    if guess is not None and guess.any():
        free = guess.copy()
        for _ in range(6):  # all columns on the wrong side change sides at once, which mostly settles
            x, at = np.zeros(n), np.flatnonzero(free)
            x[at] = _solved(g[at[:, None], at], c[at])
            wrong = np.where(free, x <= 0, c - g @ x > least)
            if not wrong.any():
                return x / scale
            free ^= wrong
            if not free.any():
                break
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        grad = c - g @ x
        grad[free] = -np.inf
        if free.all() or grad.max() <= least:
            break
        free[grad.argmax()] = True
        while True:
            s, at = np.zeros(n), np.flatnonzero(free)
            s[at] = _solved(g[at[:, None], at], c[at])
            if s[at].min() > 0:
                x = s
                break
            down = free & (s <= 0)
            t = np.min(x[down] / np.maximum(x[down] - s[down], 1e-300))
            x = x + t * (s - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x / scale


def fit_bounded(residual, start: np.ndarray, low: np.ndarray, high: np.ndarray, *, tol: float = 1e-3, rounds: int = 60, slopes=None) -> tuple[np.ndarray, bool]:
    """Parameters within bounds of least squared residual, and whether steps became small; bounds hold by a sine transform.

    ``slopes`` gives the derivatives of the residual by the parameters, else differences do.
    """
    half, mid = (high - low) / 2, (high + low) / 2
    out = lambda t: mid + half * np.sin(t)
    t = np.arcsin(np.clip((start - mid) / half, -0.999, 0.999))
    r = residual(out(t))
    cost, damp = r @ r, 1e-3
    for _ in range(rounds):
        jac = slopes(out(t)) * (half * np.cos(t)) if slopes else np.stack([(residual(out(t + step)) - r) / 1e-5 for step in np.eye(len(t)) * 1e-5], 1)
        g, h = jac.T @ r, jac.T @ jac
        for _ in range(12):
            move = np.linalg.solve(h + damp * (np.diag(np.diag(h)) + 1e-12 * np.eye(len(t))), -g)
            new = residual(out(t + move))
            if new @ new < cost:
                break
            damp *= 4
        else:
            return out(t), True
        gain = (cost - new @ new) / max(cost, 1e-300)
        t, r, cost, damp = t + move, new, new @ new, max(damp / 5, 1e-9)
        if gain < tol * tol or np.abs(move).max() < tol * 1e-2:
            return out(t), True
    return out(t), False
