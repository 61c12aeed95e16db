"""Aperture illumination patterns and the kernels that follow from them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _radius(n: int, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (np.arange(n) - n // 2) * cell
    u, v = np.meshgrid(x, x, indexing="ij")
    return np.hypot(u, v), u, v


def disk(n: int, cell: float, diameter: float, hole: float = 0.0) -> np.ndarray:
    """Uniform between the hole and the rim."""
    r, _, _ = _radius(n, cell)
    return ((r <= diameter / 2) & (r >= hole / 2)).astype(complex)


def tapered(n: int, cell: float, diameter: float, hole: float = 0.0, edge_db: float = -10.0, legs: float = 0.0) -> np.ndarray:
    """Gaussian fall-off to edge_db at the rim; feed legs of the given width along both axes are dark."""
    r, u, v = _radius(n, cell)
    out = disk(n, cell, diameter, hole) * 10 ** (edge_db / 20 * (2 * r / diameter) ** 2)
    if legs > 0:
        out[((np.abs(u) < legs / 2) | (np.abs(v) < legs / 2)) & (r > hole / 2)] = 0
    return out


def wedged(pattern: np.ndarray, cell: float, start: float, half_angle: float, legs: tuple[float, ...] = (0.0, math.pi / 2, math.pi, 1.5 * math.pi), turn: float = 0.0) -> np.ndarray:
    """The pattern with the shadows that feed legs throw outwards: dark wedges from radius start on, to both sides of every leg's direction by half_angle.

    turn rotates legs as the dish turns on the sky (parallactic angle); the pattern itself is taken as it is.
    """
    r, u, v = _radius(len(pattern), cell)
    angle = np.arctan2(v, u)
    dark = np.zeros(pattern.shape, bool)
    for leg in legs:
        dark |= np.abs((angle - leg - turn + math.pi) % (2 * math.pi) - math.pi) < half_angle
    return np.where(dark & (r > start), 0, pattern)


def offset(pattern: np.ndarray, cell: float, l: float, m: float, wavelength: float) -> np.ndarray:  # noqa: E741
    """The pattern of a feed that looks off axis: a phase slope over the aperture."""
    _, u, v = _radius(len(pattern), cell)
    return pattern * np.exp(2j * math.pi * (u * l + v * m) / wavelength)


def composite(pattern: Callable[[], np.ndarray], cell: float, wavelength: float, elements: list[tuple[float, float, complex]]) -> np.ndarray:
    """Weighted sum of one pattern seen at several offsets."""
    return sum(w * offset(pattern(), cell, l, m, wavelength) for l, m, w in elements)


PATTERNS: dict[str, Callable[..., np.ndarray]] = {"disk": disk, "tapered": tapered, "wedged": lambda n, cell, diameter, hole, start, half_angle, turn=0.0, edge_db=-10.0: wedged(tapered(n, cell, diameter, hole, edge_db), cell, start, half_angle, turn=turn)}


def aw_kernel_rows(patterns: dict[int, np.ndarray], w_planes: list[float], field: float, support: int, oversample: int = 4) -> list[tuple]:
    """AW-projection: plane feed * len(w_planes) + k holds the feed's power pattern times the phase screen of w_planes[k] (wavelengths) over a field of that many radians."""
    out = {}
    for feed, p in patterns.items():
        n = len(p)
        x = (np.arange(n) - n // 2) * field / n
        r2 = np.minimum(x[:, None] ** 2 + x[None] ** 2, 1.0)
        for k, w in enumerate(w_planes):
            out[feed * len(w_planes) + k] = (p, np.exp(-2j * math.pi * w * (1 - np.sqrt(1 - r2))))
    return _kernel_rows(out, support, oversample)


def a_kernel_rows(patterns: dict[int, np.ndarray], support: int, oversample: int = 4) -> list[tuple]:
    """Kernel rows per plane (here: feed): the autocorrelation of the illumination, unit sum per oversampling step."""
    return _kernel_rows({plane: (p, 1.0) for plane, p in patterns.items()}, support, oversample)


def rotated(pattern: np.ndarray, angle: float) -> np.ndarray:
    """The pattern turned by an angle, as a feed on an alt-az mount sees it: nearest cells."""
    n = len(pattern)
    i, j = np.indices(pattern.shape) - n // 2
    c, s = math.cos(angle), math.sin(angle)
    x, y = np.rint(c * i + s * j).astype(int) + n // 2, np.rint(c * j - s * i).astype(int) + n // 2
    inside = (x >= 0) & (x < n) & (y >= 0) & (y < n)
    return np.where(inside, pattern[np.clip(x, 0, n - 1), np.clip(y, 0, n - 1)], 0)


def _kernel_rows(patterns: dict[int, tuple], support: int, oversample: int) -> list[tuple]:
    rows = []
    for plane, (p, screen) in patterns.items():
        n = len(p)
        padded = np.zeros((n * oversample, n * oversample), complex)
        at = (n * oversample - n) // 2
        power = np.abs(np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(p)))) ** 2
        padded[at : at + n, at : at + n] = power / power.max() * screen
        k = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(padded)))
        c = n * oversample // 2
        for fu in range(oversample):
            for fv in range(oversample):
                own = np.array([[k[c + i * oversample + fu, c + j * oversample + fv] for j in range(-support, support + 1)] for i in range(-support, support + 1)])
                total = own.real.sum()
                rows += [(plane, fu, fv, i - support, j - support, float(z.real / total), float(z.imag / total)) for (i, j), z in np.ndenumerate(own)]
    return rows
