"""Fitting sky components to samples: analytic derivatives as columns, normal equations as grouped sums.

A round is one pass: Spark sums the products of derivatives and residuals over
all samples, the driver solves for the few parameters of the sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.scalar import C_LIGHT

#: Parameters of a point source; of a Gaussian besides.
POINT, GAUSSIAN = ("flux", "l", "m", "alpha"), ("bmaj", "bmin", "bpa")
_WIDTH = math.pi**2 / (4 * math.log(2))


def _times_i(z: Cx) -> Cx:
    return Cx(-z.im, z.re)


def visibility(c: dict, freq: str = "freq") -> Cx:
    """A component's visibility over (u, v, w in metres, freq)."""
    z = S.point_source(freq, "u", "v", "w", c["flux"], c["l"], c["m"], c.get("alpha", 0.0), c.get("f0", 1.0))
    return z * S.gaussian_taper(freq, "u", "v", c["bmaj"], c["bmin"], c["bpa"]) if "bmaj" in c else z


def derivatives(c: dict, names: list[str], freq: str = "freq") -> dict[str, Cx]:
    """How the visibility moves with each parameter; the flux's comes from a source of unit flux, so that it may be 0."""
    unit = visibility({**c, "flux": 1.0}, freq)
    z = unit * F.lit(float(c["flux"]))
    nu = F.col(freq)
    n = math.sqrt(1 - c["l"] ** 2 - c["m"] ** 2)
    wave = 2 * math.pi * nu / C_LIGHT
    out = {}
    for name in names:
        if name == "flux":
            out[name] = unit
        elif name in ("l", "m"):
            out[name] = _times_i(z) * (wave * (F.col("u" if name == "l" else "v") - F.col("w") * (c[name] / n)))
        elif name == "alpha":
            out[name] = z * F.log(nu / F.lit(float(c.get("f0", 1.0))))
        else:
            cos, sin = math.cos(c["bpa"]), math.sin(c["bpa"])
            up, vp = (cos * F.col("u") + sin * F.col("v")) / C_LIGHT, (cos * F.col("v") - sin * F.col("u")) / C_LIGHT
            k = -2 * _WIDTH * nu * nu
            by = {"bmaj": c["bmaj"] * up * up, "bmin": c["bmin"] * vp * vp, "bpa": (c["bmaj"] ** 2 - c["bmin"] ** 2) * up * vp}
            out[name] = z * (k * by[name])
    return out


@dataclass
class Fit:
    """Components after the last round; errors of free parameters (source, name) from the normal equations; misfits by round."""

    components: list[dict]
    errors: dict[tuple[int, str], float]
    misfits: list[float] = field(default_factory=list)
    converged: bool = False


def _equations(samples: DataFrame, components: list[dict], free: list[tuple[int, str]], weight: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(normal matrix, slopes, weighted misfit, samples) of one pass."""
    rest = Cx.of("re", "im")
    columns: dict[str, Column] = {}
    for i, c in enumerate(components):
        rest = rest - visibility(c)
        for name, z in derivatives(c, [n for k, n in free if k == i]).items():
            columns |= {f"_{i}_{name}_re": z.re, f"_{i}_{name}_im": z.im}
    s = samples.select(weight.alias("_w"), rest.re.alias("_r_re"), rest.im.alias("_r_im"), *[c.alias(n) for n, c in columns.items()])
    names = [f"_{i}_{n}" for i, n in free]
    dot = lambda a, b: F.sum(F.col("_w") * (F.col(f"{a}_re") * F.col(f"{b}_re") + F.col(f"{a}_im") * F.col(f"{b}_im")))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = s.agg(*[dot(names[i], names[j]).alias(f"a{i}_{j}") for i, j in pairs], *[dot(n, "_r").alias(f"y{i}") for i, n in enumerate(names)], dot("_r", "_r").alias("m"), F.count("_r_re").alias("n")).first()
    a = np.zeros((len(names), len(names)))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"y{i}"] or 0.0 for i in range(len(names))]), float(row["m"] or 0.0), int(row["n"])


def _moved(components: list[dict], free: list[tuple[int, str]], step: np.ndarray) -> list[dict]:
    out = [dict(c) for c in components]
    for (i, name), x in zip(free, step, strict=True):
        out[i][name] += float(x)
    return out


def fitted(samples: DataFrame, components: list[dict], free: list[tuple[int, str]], weight: Column, rounds: int = 20, tolerance: float = 1e-8) -> Fit:
    """Components (flux, l, m, alpha, f0 and, for a Gaussian, bmaj, bmin, bpa) moved in their free parameters to fit samples (u, v, w, freq, re, im).

    Damped Gauss-Newton: the damping grows until a step lowers the misfit, and
    falls after it. Parameters are scaled by their own curvature; one that no
    sample tells anything about stays.
    """
    now, damping = [dict(c) for c in components], 1e-3
    a, y, misfit, n = _equations(samples, now, free, weight)
    fit = Fit(now, {}, [misfit])
    for _ in range(rounds):
        scale = np.sqrt(np.maximum(np.diag(a), 0))
        told = scale > 0
        if not told.any():
            break
        unit = a[np.ix_(told, told)] / np.outer(scale[told], scale[told])
        step = np.zeros(len(free))
        step[told] = np.linalg.lstsq(unit + damping * np.eye(len(unit)), y[told] / scale[told], rcond=1e-12)[0] / scale[told]
        then = _moved(now, free, step)
        possible = all(c["l"] ** 2 + c["m"] ** 2 < 1 for c in then)
        new = _equations(samples, then, free, weight) if possible else None
        if new is None or not new[2] <= misfit:
            damping *= 10
            if damping > 1e12:
                break
            continue
        small = misfit - new[2] <= tolerance * max(misfit, 1e-300)
        now, (a, y, misfit, n), damping = then, new, damping / 10
        fit.misfits.append(misfit)
        if small:
            fit.converged = True
            break
    fit.components = now
    spread = misfit / max(1, 2 * n - len(free))
    covariance = np.linalg.pinv(a, rcond=1e-14) * spread
    fit.errors = {f: float(math.sqrt(max(covariance[i, i], 0))) for i, f in enumerate(free)}
    return fit
