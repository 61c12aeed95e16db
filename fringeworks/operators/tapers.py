"""Filters of the transform that are tuned to what they make of the point-spread function."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import deconv as D

_SIGMA2 = 8 * math.log(2)


def normalised_wiener(psf: np.ndarray, dirty: np.ndarray, robustness: float) -> tuple[np.ndarray, np.ndarray]:
    """Both images through the Wiener filter whose noise is 10^(2 robustness) of the peak, the peak of the point-spread function as before."""
    top = psf.max()
    z = np.fft.fft2(np.fft.ifftshift(psf))
    f = top * z.conj() / (np.abs(z) ** 2 + (10 ** (2 * robustness) * top) ** 2)
    seen = lambda x: np.fft.ifft2(np.fft.fft2(x) * f).real
    out = seen(psf)
    return out * top / out.max(), seen(dirty) * top / out.max()


def covariance(beam: tuple[float, float, float]) -> np.ndarray:
    """Of a Gaussian of widths at half maximum (major, minor) and the angle of the major axis from x."""
    c, s = math.cos(beam[2]), math.sin(beam[2])
    turn = np.array([[c, -s], [s, c]])
    return turn @ np.diag([beam[0] ** 2, beam[1] ** 2]) @ turn.T / _SIGMA2


def _possible(t: np.ndarray) -> np.ndarray:
    """The nearest covariance: nothing is sharpened."""
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    return vectors @ np.diag(np.maximum(values, 0)) @ vectors.T


def smoothed(image: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The image convolved with a Gaussian of covariance t (pixels)."""
    fx, fy = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None]
    f = np.exp(-2 * math.pi**2 * (t[0, 0] * fx * fx + 2 * t[0, 1] * fx * fy + t[1, 1] * fy * fy))
    return np.fft.ifft2(np.fft.fft2(image) * f).real


@dataclass
class Tuned:
    """Images of the asked beam, the beam that is fitted to them, the taper's covariance, and whether the widths are right."""

    psf: np.ndarray
    dirty: np.ndarray
    beam: tuple[float, float, float]
    taper: np.ndarray
    rounds: int
    reached: bool


def tuned_taper(psf: np.ndarray, dirty: np.ndarray, beam: tuple[float, float, float], tolerance: float = 0.005, rounds: int = 30) -> Tuned:
    """A Gaussian taper such that the beam fitted to the tapered point-spread function is the asked one.

    The main lobe is no Gaussian, so widths do not add up: the taper is moved by
    what the fitted beam lacks, round by round. A direction in which the beam is
    wider than asked without any taper stays as it is, and is not reached.
    """
    want, top = covariance(beam), psf.max()
    t = _possible(want - covariance(D.fit_beam(psf)))
    turn = 0
    while True:
        seen = smoothed(psf, t)
        got = D.fit_beam(seen)
        lacks = want - covariance(got)
        error = np.abs(lacks).max() / np.abs(want).max()
        if error <= tolerance or turn >= rounds:
            break
        t, turn = _possible(t + lacks), turn + 1
    scale = top / seen.max()
    return Tuned(seen * scale, smoothed(dirty, t) * scale, got, t, turn, bool(error <= tolerance))
