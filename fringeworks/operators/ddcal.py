"""Direction-dependent calibration: gains of every antenna towards several directions at once.

Samples are reduced to sums per baseline before anything is solved: of the
sample with each direction's model, and of every pair of models. These are
grouped sums of expressions; what is left of a key is antennas squared times
directions squared numbers, however many samples there were.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx


def products(rows: DataFrame, by: list[str], value: Cx, models: list[Cx], weight: Column) -> DataFrame:
    """by, antenna1, antenna2, v (2 D numbers), m (2 D D numbers): sums of weight conj(model) value and weight conj(model) model', real and imaginary parts in turns, and vv, the sum of weight |value|^2.

    Each model is worked out once a row; a pair and its mirror image are one sum.
    """
    n = len(models)
    named = {f"_m{d}_{p}": x for d, z in enumerate(models) for p, x in (("re", z.re), ("im", z.im))}
    rows = rows.select(*by, "antenna1", "antenna2", value.re.alias("_v_re"), value.im.alias("_v_im"), weight.alias("_w"), *[c.alias(k) for k, c in named.items()])
    v, m = Cx.of("_v_re", "_v_im"), [Cx.of(f"_m{d}_re", f"_m{d}_im") for d in range(n)]
    sums = [F.sum(F.col("_w") * v.abs2()).alias("vv")]
    for d in range(n):
        z = m[d].conj() * v * F.col("_w")
        sums += [F.sum(z.re).alias(f"_a{d}_re"), F.sum(z.im).alias(f"_a{d}_im")]
        for e in range(d, n):
            z = m[d].conj() * m[e] * F.col("_w")
            sums += [F.sum(z.re).alias(f"_p{d}_{e}_re"), F.sum(z.im).alias(f"_p{d}_{e}_im")]
    out = rows.where("antenna1 <> antenna2").groupBy(*by, "antenna1", "antenna2").agg(*sums)
    pair = lambda d, e: (F.col(f"_p{d}_{e}_re"), F.col(f"_p{d}_{e}_im")) if d <= e else (F.col(f"_p{e}_{d}_re"), -F.col(f"_p{e}_{d}_im"))
    return out.select(
        *by,
        "antenna1",
        "antenna2",
        F.array(*[F.col(f"_a{d}_{p}") for d in range(n) for p in ("re", "im")]).alias("v"),
        F.array(*[x for d in range(n) for e in range(n) for x in pair(d, e)]).alias("m"),
        "vv",
    )


def _complex(column, shape: tuple[int, ...]) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in column]).reshape(len(column), -1, 2)
    return (x[..., 0] + 1j * x[..., 1]).reshape(len(column), *shape)


def misfit(g: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, m: np.ndarray, vv: float) -> float:
    """The weighted sum of squares that gains g[antenna, direction] leave."""
    h = g[i] * g[j].conj()
    return float(vv + np.einsum("bd,bde,be->", h.conj(), m, h).real - 2 * (h.conj() * v).sum().real)


def step(g: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Gauss-Newton step from g: block normal equations of all antennas and directions, least in norm as phases are free."""
    n, d = g.shape
    gi, gj = g[i], g[j]
    rest = v - np.einsum("bde,be->bd", m, gi * gj.conj())
    kernel = np.block([[m.real, -m.imag], [m.imag, m.real]])
    j_real = np.zeros((len(i), 2 * d, 4 * d))
    k = np.arange(d)
    # how the product of the two gains moves with the parts of the first gain and of the second
    for row, col, x in ((0, 0, gj.real), (0, 1, gj.imag), (1, 0, -gj.imag), (1, 1, gj.real), (0, 2, gi.real), (0, 3, gi.imag), (1, 2, gi.imag), (1, 3, -gi.real)):
        j_real[:, row * d + k, col * d + k] = x
    block = np.einsum("brp,brs,bsq->bpq", j_real, kernel, j_real, optimize=True)
    slope = np.einsum("brp,br->bp", j_real, np.concatenate([rest.real, rest.imag], 1))
    # unknowns: real parts of all, then imaginary parts of all
    at = np.concatenate([i[:, None] * d + k, n * d + i[:, None] * d + k, j[:, None] * d + k, n * d + j[:, None] * d + k], 1)
    normal, y = np.zeros((2 * n * d, 2 * n * d)), np.zeros(2 * n * d)
    np.add.at(normal, (at[:, :, None], at[:, None, :]), block)
    np.add.at(y, at, slope)
    x = np.linalg.lstsq(normal, y, rcond=1e-10)[0]
    return (x[: n * d] + 1j * x[n * d :]).reshape(n, d)


def solve(n: int, directions: int, i, j, v, m, vv: float, rounds: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, int, bool]:
    """(gains[antenna, direction], rounds, converged): steps are halved until the misfit falls."""
    g = np.ones((n, directions), complex)
    now = misfit(g, i, j, v, m, vv)
    for turn in range(1, rounds + 1):
        change, part = step(g, i, j, v, m), 1.0
        while part > 1e-6 and (after := misfit(g + part * change, i, j, v, m, vv)) > now:
            part /= 2
        if part <= 1e-6:
            return g, turn, bool(np.linalg.norm(change) <= 1e-6 * np.linalg.norm(g))
        g, now = g + part * change, after
        if part * np.linalg.norm(change) <= tolerance * np.linalg.norm(g):
            return g, turn, True
    return g, rounds, False


def solved(sums: DataFrame, by: list[str], antennas: int, directions: int, reference: int = 0) -> DataFrame:
    """by, antenna, direction, g_re, g_im, valid, rounds, converged: keys side by side, phases of each direction turned to the reference antenna's.

    An antenna without a sample towards a direction is 1 there and not valid.
    """
    import pandas as pd

    types = dict(sums.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["antenna int, direction int, g_re double, g_im double, valid boolean, rounds int, converged boolean"])

    def run(key, pdf):
        i, j = (pdf[c].to_numpy(np.int64) for c in ("antenna1", "antenna2"))
        v, m = _complex(pdf["v"], (directions,)), _complex(pdf["m"], (directions, directions))
        g, rounds, converged = solve(antennas, directions, i, j, v, m, float(pdf["vv"].sum()))
        power = np.zeros((antennas, directions))
        for side in (i, j):
            np.add.at(power, side, np.einsum("bdd->bd", m).real)
        turn = g[reference]
        g = np.where(power > 0, g * np.where(np.abs(turn) > 0, turn.conj() / np.maximum(np.abs(turn), 1e-300), 1), 1.0)
        a, d = (x.ravel().astype("int32") for x in np.indices(g.shape))
        return pd.DataFrame({**{b: [k] * g.size for b, k in zip(by, key, strict=True)}, "antenna": a, "direction": d, "g_re": g.real.ravel(), "g_im": g.imag.ravel(), "valid": (power > 0).ravel(), "rounds": rounds, "converged": converged})

    return sums.groupBy(*by).applyInPandas(run, schema)
