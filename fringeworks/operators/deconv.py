"""Deconvolution, preconditioning and restoration of image planes.

A plane is bounded by its shape, so each is one grouped NumPy stage; planes
(polarisation, channel, image) run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame


@dataclass
class Control:
    """When to stop: targets of the largest residual, iterations, divergence.

    With deep, reaching the targets begins a deep phase: only pixels that hold
    components already are searched, down to deep.
    """

    max_iterations: int = 100
    gain: float = 0.1
    absolute: float = 0.0
    fraction: float = 0.0
    deep: float = 0.0
    diverging: float = 2.0
    first: float | None = field(default=None)
    is_deep: bool = False

    def cause(self, iteration: int, peak: float) -> str | None:
        peak = abs(peak)
        if self.first is None:
            self.first = peak
        target = self.deep if self.is_deep else max(self.absolute, self.fraction * self.first)
        if peak <= target and not self.is_deep and 0 < self.deep < target and peak > 0:
            self.is_deep, target = True, self.deep
        if peak <= target or peak == 0:
            return "CONVERGED"
        if peak > self.diverging * self.first:
            return "DIVERGED"
        if iteration >= self.max_iterations:
            return "EXCEEDEDITERATIONS"
        return None


def peak_of(image: np.ndarray, weight: np.ndarray | None = None) -> tuple[int, int]:
    """Place of the largest absolute weighted value; the first in row order at a tie."""
    a = np.abs(image if weight is None else image * weight)
    i = int(a.argmax())
    return i // image.shape[1], i % image.shape[1]


def subtract_shifted(image: np.ndarray, psf: np.ndarray, at: tuple[int, int], scale: float) -> None:
    """image -= scale * psf with the psf's centre moved to at; what falls outside is lost."""
    n, m = image.shape
    cx, cy = psf.shape[0] // 2, psf.shape[1] // 2
    x0, x1 = max(0, at[0] - cx), min(n, at[0] - cx + psf.shape[0])
    y0, y1 = max(0, at[1] - cy), min(m, at[1] - cy + psf.shape[1])
    image[x0:x1, y0:y1] -= scale * psf[x0 - at[0] + cx : x1 - at[0] + cx, y0 - at[1] + cy : y1 - at[1] + cy]


def hogbom(dirty: np.ndarray, psf: np.ndarray, control: Control, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """(model, residual, cause)."""
    residual, model, i = dirty.astype(float).copy(), np.zeros(dirty.shape), 0
    while True:
        at = peak_of(residual, weight)
        was_deep = control.is_deep
        if control.is_deep:
            at = peak_of(residual, (model != 0) * (1.0 if weight is None else weight))
        if cause := control.cause(i, residual[at]):
            return model, residual, cause
        if control.is_deep and not was_deep:
            continue  # the phase begins: search again, among pixels with components
        model[at] += control.gain * residual[at]
        subtract_shifted(residual, psf, at, control.gain * residual[at])
        i += 1


def fft_convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution; the kernel's origin is its middle."""
    return np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(np.fft.ifftshift(kernel))).real


def scale_function(shape: tuple[int, int], scale: float) -> np.ndarray:
    """Multi-scale basis function of a width in pixels: a spheroidal-shaped bump of unit sum, a point for 0."""
    from ..functions.scalar import spheroidal_value

    out = np.zeros(shape)
    cx, cy = shape[0] // 2, shape[1] // 2
    if scale <= 0:
        out[cx, cy] = 1.0
        return out
    x, y = np.indices(shape)
    r = np.hypot(x - cx, y - cy) / scale
    out = np.where(r < 1, (1 - r * r) * np.vectorize(spheroidal_value)(np.minimum(r, 1)), 0)
    return out / out.sum()


def gram_schmidt(basis: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for b in basis:
        v = b.astype(float).copy()
        for o in out:
            v -= (v * o).sum() * o
        out.append(v / np.sqrt((v * v).sum()))
    return out


def multi_term(dirty: list[np.ndarray], psf: list[np.ndarray], scales: list[float], control: Control, criterion: str = "MAXBASE") -> tuple[list[np.ndarray], list[np.ndarray], str]:
    """Multi-term multi-scale clean: dirty[t] and psf[t + u] for Taylor terms t, u; residuals are projected on scales and decoupled."""
    n_terms, shape = len(dirty), dirty[0].shape
    basis = [scale_function(shape, s) for s in scales]
    project = lambda image, b: fft_convolve(image, b)
    residual = [d.astype(float).copy() for d in dirty]
    model = [np.zeros(shape) for _ in dirty]
    cross = [[project(project(p, b), b) for p in psf] for b in basis]  # psf seen through a scale twice
    centre = (shape[0] // 2, shape[1] // 2)
    coupling = [np.array([[c[t + u][centre] for u in range(n_terms)] for t in range(n_terms)]) for c in cross]
    inverse = [np.linalg.pinv(c) for c in coupling]
    i, mask = 0, np.zeros(shape, bool)
    while True:
        seen = [[project(r, b) for r in residual] for b in basis]
        coeff = [np.tensordot(inv, np.array(s), 1) for inv, s in zip(inverse, seen, strict=True)]
        if criterion == "MAXTERM0":
            worth = [np.abs(c[0]) * math.sqrt(abs(k[0, 0])) for c, k in zip(coeff, coupling, strict=True)]
        elif criterion == "MAXCHISQ":
            worth = [sum(c[t] * s[t] for t in range(n_terms)) for c, s in zip(coeff, seen, strict=True)]
        else:
            worth = [np.abs(s[0]) / math.sqrt(abs(k[0, 0])) for s, k in zip(seen, coupling, strict=True)]
        if control.is_deep:
            worth = [np.where(mask, w, 0) for w in worth]
        best = int(np.argmax([w.max() for w in worth]))
        at = peak_of(worth[best])
        if cause := control.cause(i, np.abs(residual[0][mask] if control.is_deep and mask.any() else residual[0]).max()):
            return model, residual, cause
        mask[at] = True
        spot = np.zeros(shape)
        spot[at] = 1.0
        shown = project(spot, basis[best])
        for t in range(n_terms):
            model[t] += control.gain * coeff[best][t][at] * shown
        for t in range(n_terms):
            for u in range(n_terms):
                residual[t] -= control.gain * coeff[best][u][at] * fft_convolve(shown, psf[t + u])
        i += 1


def resolutions(image: np.ndarray, widths: list[float]) -> np.ndarray:
    """A redundant transform: what the image loses from each Gaussian width (pixels, ascending) to the next, and the smoothest last."""
    n, m = image.shape
    f = np.hypot(np.fft.fftfreq(n)[:, None], np.fft.fftfreq(m)[None])
    z = np.fft.fft2(image)
    smooth = [image] + [np.fft.ifft2(z * np.exp(-2 * (math.pi * w * f) ** 2)).real for w in widths]
    return np.stack([a - b for a, b in zip(smooth, smooth[1:], strict=False)] + [smooth[-1]])


def from_resolutions(planes: np.ndarray) -> np.ndarray:
    """The image that resolutions takes apart."""
    return planes.sum(axis=0)


def resolutions_adjoint(planes: np.ndarray, widths: list[float]) -> np.ndarray:
    """The adjoint of resolutions: its smoothings are symmetric."""
    return sum(resolutions(p, widths)[i] for i, p in enumerate(planes))


def fista_redundant(dirty: np.ndarray, psf: np.ndarray, widths: list[float], control: Control, fraction: float = 0.5) -> tuple[np.ndarray, np.ndarray, float, str]:
    """(model, residual, last lambda, cause): proximal gradient with momentum, shrinking every resolution but the smoothest.

    A resolution shrinks by lambda times what unit noise is in it. lambda begins at a fraction of the peak and falls by the control's gain
    whenever the peak residual is below it; without widths pixels are shrunk.
    """
    transfer = np.fft.fft2(np.fft.ifftshift(psf))
    step = float((np.abs(transfer) ** 2).max())
    seen = lambda x: np.fft.ifft2(transfer * np.fft.fft2(x)).real
    shrunk = lambda x, t: np.sign(x) * np.maximum(np.abs(x) - t, 0)
    spot = np.zeros(dirty.shape)
    spot[0, 0] = 1.0
    share = np.sqrt((resolutions(spot, widths) ** 2).sum(axis=(1, 2), keepdims=True))
    share[-1] = 0.0
    x = y = np.zeros(dirty.shape)
    level, t, i = fraction * float(np.abs(dirty).max()), 1.0, 0
    while True:
        residual = dirty - seen(x)
        peak = float(np.abs(residual).max())
        if cause := control.cause(i, peak):
            return x, residual, level, cause
        if peak < level:
            level *= 1 - control.gain
        z = y + np.fft.ifft2(np.conj(transfer) * np.fft.fft2(dirty - seen(y))).real / step
        new = from_resolutions(shrunk(resolutions(z, widths), level / step * share)) if widths else shrunk(z, level / step)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t, i = new, t_new, i + 1


def fista(dirty: np.ndarray, psf: np.ndarray, threshold: float, iterations: int = 50) -> np.ndarray:
    """Proximal gradient with momentum and soft thresholding."""
    transfer = np.fft.fft2(np.fft.ifftshift(psf))
    step = float((np.abs(transfer) ** 2).max())
    x = y = np.zeros(dirty.shape)
    t = 1.0
    for _ in range(iterations):
        grad = np.fft.ifft2(np.conj(transfer) * (np.fft.fft2(dirty) - transfer * np.fft.fft2(y))).real
        z = y + grad / step
        new = np.sign(z) * np.maximum(np.abs(z) - threshold / step, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def maximum_entropy(dirty: np.ndarray, psf: np.ndarray, sigma: float, scale: float, iterations: int = 60, kind: str = "emptiness", flux: float | None = None, tolerance: float = 0.3) -> tuple[np.ndarray, float]:
    """(image, its root mean square misfit): the most entropic image that fits the dirty image to sigma.

    Newton steps with a diagonal Hessian on J = H - alpha * chi2 / 2 - beta * flux.
    H is the information entropy -sum m log(m / (e * scale)) of a positive image,
    or the emptiness -scale * sum log cosh(m / scale). alpha grows while the
    misfit is above sigma and shrinks below it; beta does so for a wanted flux.
    """
    transfer = np.fft.fft2(np.fft.ifftshift(psf))
    volume = float(psf[psf > 0.1].sum())
    seen = lambda m: dirty - np.fft.ifft2(transfer * np.fft.fft2(m)).real
    back = lambda r: np.fft.ifft2(np.conj(transfer) * np.fft.fft2(r)).real
    positive = kind == "information"
    model = np.full(dirty.shape, scale)
    alpha, beta, target = 0.0, 0.0, sigma * sigma * dirty.size
    for _ in range(iterations):
        residual = seen(model)
        chi2 = float((residual * residual).sum())
        if positive:
            grad_h, curve = -np.log(model / scale), 1 / model
        else:
            grad_h, curve = -np.tanh(model / scale), np.maximum(1 / np.cosh(np.clip(model / scale, -30, 30)) ** 2, 1e-3) / scale
        grad_c = back(residual)
        if alpha == 0:
            # a model without a gradient of its own, as at the start of an entropy, begins at a tenth
            alpha = float(np.sqrt(max((grad_h * grad_h).sum(), 0.01 * dirty.size) / max((grad_c * grad_c).sum(), 1e-300)))
        if chi2 > target:
            alpha *= 1.2
        elif chi2 < 0.8 * target:
            alpha /= 1.2
        if flux is not None:
            beta += 0.1 * (float(model.sum()) - flux) / max(abs(flux), 1e-12)
        step = (grad_h + alpha * grad_c - beta) / (curve + alpha * volume * volume)
        # within the range where the quadratic form holds, and never uphill beyond it
        limit = tolerance * max(float(np.abs(model).max()), scale)
        step = np.clip(step, -limit, limit)
        if positive:
            step = np.maximum(step, -tolerance * model)
        length, old = 1.0, float(grad_h.ravel() @ step.ravel() + alpha * (grad_c.ravel() @ step.ravel()))
        trial = model + step
        new_h = -np.log(np.maximum(trial, 1e-300) / scale) if positive else -np.tanh(trial / scale)
        new = float(new_h.ravel() @ step.ravel() + alpha * (back(seen(trial)).ravel() @ step.ravel()))
        if old > 0 and new < old:
            length = min(1.0 if new >= 0 else old / (old - new), 1.0)
        model = model + length * step
        if positive:
            model = np.maximum(model, 1e-6 * scale)
    residual = seen(model)
    return model, float(np.sqrt((residual * residual).mean()))


def robust_filter(psf: np.ndarray, dirty: np.ndarray, robustness: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights 1 / (1 + |FT(psf)| / (10^(2 robustness) * peak)); both keep the psf's peak."""
    t = np.fft.fft2(np.fft.ifftshift(psf))
    f = 1 / (np.abs(t) / (10 ** (2 * robustness) * psf.max()) + 1)
    return _filtered(psf, dirty, f)


def wiener_filter(psf: np.ndarray, dirty: np.ndarray, noise_power: float | None = None, robustness: float | None = None, taper: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """conj(T) / (|T|^2 + noise) with T the transform of the psf scaled to unit peak of the transform.

    The noise power is given, or follows from a robustness as 10^(4 r). taper is
    the width (pixels, half maximum) of a Gaussian that smooths T in the image first.
    """
    if (noise_power is None) == (robustness is None):
        raise ValueError("either a noise power or a robustness")
    noise = noise_power if robustness is None else 10.0 ** (4 * robustness)
    shape = psf if taper is None else psf * gaussian_beam(psf.shape, taper, taper, 0.0)
    t = np.fft.fft2(np.fft.ifftshift(shape))
    t = t / np.abs(t).max()
    return _filtered(psf, dirty, np.conj(t) / (np.abs(t) ** 2 + noise))


def gaussian_taper(psf: np.ndarray, dirty: np.ndarray, fwhm: float) -> tuple[np.ndarray, np.ndarray]:
    """Both seen through a round Gaussian of the width in pixels."""
    fx = np.fft.fftfreq(psf.shape[0])[:, None]
    fy = np.fft.fftfreq(psf.shape[1])[None]
    return _filtered(psf, dirty, np.exp(-((math.pi * fwhm) ** 2) * (fx * fx + fy * fy) / (4 * math.log(2))))


def _filtered(psf, dirty, f):
    seen = lambda a: np.fft.fftshift(np.fft.ifft2(np.fft.fft2(np.fft.ifftshift(a)) * f)).real
    p, d = seen(psf), seen(dirty)
    k = psf.max() / p.max()
    return p * k, d * k


PRECONDITIONERS = {"robust": robust_filter, "wiener": wiener_filter, "taper": gaussian_taper}


def fit_beam(psf: np.ndarray, cutoff: float = 0.5) -> tuple[float, float, float]:
    """(major, minor, angle): widths at half maximum of a Gaussian fitted to the main lobe, by weighted least squares of logarithms."""
    c = np.unravel_index(int(psf.argmax()), psf.shape)
    x, y = np.indices(psf.shape)
    dx, dy = x - c[0], y - c[1]
    near = (psf > cutoff * psf.max()) & (np.hypot(dx, dy) < min(psf.shape) / 4)
    if near.sum() < 4:
        return 1.0, 1.0, 0.0
    a = np.stack([dx[near] ** 2, dx[near] * dy[near], dy[near] ** 2], 1).astype(float)
    p = np.linalg.lstsq(a * psf[near][:, None], -np.log(psf[near] / psf.max()) * psf[near], rcond=None)[0]
    q = np.array([[p[0], p[1] / 2], [p[1] / 2, p[2]]])
    values, vectors = np.linalg.eigh(q)
    widths = 2 * np.sqrt(math.log(2) / np.maximum(values, 1e-12))
    return float(widths[0]), float(widths[1]), float(math.atan2(vectors[1, 0], vectors[0, 0]))


def gaussian_beam(shape: tuple[int, int], major: float, minor: float, angle: float) -> np.ndarray:
    x, y = np.indices(shape)
    x, y = x - shape[0] // 2, y - shape[1] // 2
    a = x * math.cos(angle) + y * math.sin(angle)
    b = y * math.cos(angle) - x * math.sin(angle)
    return np.exp(-4 * math.log(2) * ((a / major) ** 2 + (b / minor) ** 2))


def restored(model: np.ndarray, residual: np.ndarray, beam: tuple[float, float, float]) -> np.ndarray:
    return fft_convolve(model, gaussian_beam(model.shape, *beam)) + residual


def per_plane(planes: DataFrame, keys: list[str], n: int, work, columns: list[str], names: list[str]) -> DataFrame:
    """Runs work({column: n x n array}) -> {name: n x n array} for every plane of pixels (keys, x, y, columns)."""
    import pandas as pd

    schema = ", ".join(f"{k} {dict(planes.dtypes)[k]}" for k in keys) + ", x int, y int, " + ", ".join(f"{c} double" for c in names)

    def run(key, pdf):
        arrays = {}
        for c in columns:
            a = np.zeros((n, n))
            a[pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf[c].to_numpy()
            arrays[c] = a
        out = work(arrays)
        x, y = np.indices((n, n))
        return pd.DataFrame({**{k: [v] * n * n for k, v in zip(keys, key, strict=True)}, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), **{c: out[c].ravel() for c in names}})

    return planes.groupBy(*keys).applyInPandas(run, schema)
