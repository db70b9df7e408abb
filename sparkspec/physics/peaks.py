"""Peak shapes and detection in one spectrum."""

from __future__ import annotations

from functools import lru_cache
from math import erfc

import numpy as np

_erfc = np.vectorize(erfc, otypes=[float])


def gaussian(x: np.ndarray, area: float, center: float, sigma: float) -> np.ndarray:
    return area / (sigma * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((x - center) / sigma) ** 2)


def tail(x: np.ndarray, area: float, center: float, sigma: float, gamma: float) -> np.ndarray:
    """Exponential tail towards low energies (Osan et al. 2001)."""
    u = (x - center) / sigma
    with np.errstate(over="ignore", invalid="ignore"):
        value = area / (2 * gamma * sigma) * np.exp(np.minimum(u / gamma + 0.5 / gamma**2, 700)) * _erfc(u / np.sqrt(2) + 1 / (np.sqrt(2) * gamma))
    return np.nan_to_num(value)


def charge_loss(center: float, mu_per_cm: float, radius_cm: float, loss: float, points: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Energies and probabilities of collected charge for a photon absorbed near the detector's face (Redus and Huber 2015).

    At depth z the share lost is that of the part of a sphere of the given
    radius that lies beyond the face; absorption falls off with z, and what is
    absorbed deeper than the radius is collected whole.
    """
    z = np.linspace(0, radius_cm, points + 1)
    cap = np.pi / 3 * (radius_cm - z) ** 2 * (2 * radius_cm + z)
    share = 1 - loss * cap / (4 / 3 * np.pi * radius_cm**3)
    weight = np.diff(1 - np.exp(-mu_per_cm * z))
    energy = center * (share[1:] + share[:-1]) / 2
    return np.r_[energy, center], np.r_[weight, np.exp(-mu_per_cm * radius_cm)]


def peak(x: np.ndarray, area: float, center: float, sigma: float, *, gamma: float = 0.0, f_tail: float = 0.0, loss: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A peak: a Gaussian, with a tail below 1.839 keV and smeared by charge loss below 5 keV, as its energy asks."""
    tailed = center <= 1.839 and f_tail > 0
    one = lambda c, a: gaussian(x, a, c, sigma) + (f_tail * tail(x, a, c, sigma, gamma) if tailed else 0.0)
    if loss is None or not 1.18 <= center <= 5:
        return one(center, area)
    energy, weight = loss
    # neighbours in energy share a term: a tenth of a width is finer than any feature
    step = np.round((center - energy) / (sigma / 10)).astype(int)
    terms = np.bincount(step, weight)
    return sum((one(center - i * sigma / 10, area * w) for i, w in enumerate(terms) if w > 1e-6), np.zeros_like(x))


@lru_cache(maxsize=1024)
def profile(center: float, sigma: float, gamma: float, f_tail: float, mu_per_cm: float, radius_cm: float, loss: float) -> tuple[np.ndarray, np.ndarray] | None:
    """A line of unit area as ``peak`` shapes it, over distances from its centre in widths; None where it is a plain Gaussian. Made once a worker."""
    tailed, lossy = center <= 1.839 and f_tail > 0, 1.18 <= center <= 5 and loss > 0 and radius_cm > 0
    if not tailed and not lossy:
        return None
    u = np.arange(-min(60.0, center / sigma), 8, 0.05)
    y = peak(u * sigma + center, sigma, center, sigma, gamma=gamma, f_tail=f_tail, loss=charge_loss(center, mu_per_cm, radius_cm, loss) if lossy else None)
    return u, y / (1 + f_tail if tailed else 1)


def find_peaks(y: np.ndarray, prominence: float, distance: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima of at least this prominence and distance, and their prominences; of near ones the higher stays."""
    up = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    found = []
    for i in up:
        left, right = np.flatnonzero(y[:i] > y[i]), np.flatnonzero(y[i + 1 :] > y[i])
        a = y[(left[-1] if len(left) else 0) : i + 1].min()
        b = y[i : (i + 1 + right[0] if len(right) else len(y) - 1) + 1].min()
        found.append(y[i] - max(a, b))
    order = [i for i in sorted(range(len(up)), key=lambda i: -y[up[i]]) if found[i] >= prominence]
    kept: list[int] = []
    for i in order:
        if all(abs(up[i] - up[j]) >= distance for j in kept):
            kept.append(i)
    kept.sort()
    return up[kept], np.array([found[i] for i in kept])


def detect(energies: np.ndarray, counts: np.ndarray, energy: float, sigma: float) -> dict:
    """Whether a line shows within three widths: found, small (prominence under 50), and, where not found, overlapped (the window slopes)."""
    at = np.flatnonzero(np.abs(energies - energy) < 3 * sigma)
    if len(at) < 4:
        return {"found": False, "small": None, "overlapped": False}
    y = counts[at]
    smooth = (y[1:] + y[:-1]) / 2
    least = max(np.mean([*smooth[:2], *smooth[-2:]]) / 10, 4)
    places, prominences = find_peaks(smooth, least)
    if len(places):
        return {"found": True, "small": bool(prominences[0] < 50), "overlapped": False}
    slope = np.polyfit(energies[at], y, 1)[0]
    return {"found": False, "small": None, "overlapped": bool(abs(slope) >= 100 * (energies[1] - energies[0]) / 0.01)}
