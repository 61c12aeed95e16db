"""Two-by-two complex algebra on columns: calibration of all four polarisations, and solves beyond gains."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from ..functions.scalar import C_LIGHT

#: Determinants below this cannot be inverted.
SINGULAR = 1e-25
#: Row-major: XX, XY, YX, YY.
Matrix = tuple[Cx, Cx, Cx, Cx]


def product(a: Matrix, b: Matrix) -> Matrix:
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]


def adjoint(a: Matrix) -> Matrix:
    return a[0].conj(), a[2].conj(), a[1].conj(), a[3].conj()


def total(a: Matrix, b: Matrix) -> Matrix:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def identity() -> Matrix:
    return Cx.of(1.0), Cx.of(0.0), Cx.of(0.0), Cx.of(1.0)


def inverse(a: Matrix) -> tuple[Matrix, Column]:
    """(inverse, squared size of the determinant); null where that is 0."""
    det = a[0] * a[3] - a[1] * a[2]
    minus = lambda x: x * -1.0
    return (a[3] / det, minus(a[1]) / det, minus(a[2]) / det, a[0] / det), det.abs2()


def jones(g11: Cx, g22: Cx, d12: Cx, d21: Cx) -> Matrix:
    """Gains on the diagonal, leakages beside it, each seen through its receptor's gain."""
    return g11, g11 * d12, g22 * d21 * -1.0, g22


def corrupted(v: Matrix, j1: Matrix, j2: Matrix) -> Matrix:
    return product(product(j1, v), adjoint(j2))


def staged(rows: DataFrame, name: str, m: Matrix) -> tuple[DataFrame, Matrix]:
    """rows with the matrix as columns of their own, and the matrix of these: expressions that use it stay short."""
    cols = {f"_{name}{i}_{p}": x for i, z in enumerate(m) for p, x in (("re", z.re), ("im", z.im))}
    return rows.withColumns(cols), tuple(Cx.of(f"_{name}{i}_re", f"_{name}{i}_im") for i in range(4))


def applied(rows: DataFrame, v: Matrix, j1: Matrix, j2: Matrix, valid: Column, flagged: Column, sigma: list[Column] | None = None, allow_flag: bool = True) -> DataFrame:
    """rows with v0_re .. v3_im, flag and, given sigma of the four polarisations, sigma0 .. sigma3.

    Visibilities go through the inverse matrices of both antennas, noise through
    the squares of what they amount to. A sample with any flagged polarisation,
    without valid solutions or with a singular matrix is flagged as a whole and
    set to 0; without allow_flag it is an error of the job, except where it is
    flagged already.
    """
    kept = rows.columns
    rows, v = staged(rows.withColumns({"_valid": valid, "_flagged": flagged, **{f"_sigma{k}": x for k, x in enumerate(sigma or [])}}), "v", v)
    inverses, regular = [], F.lit(True)
    for name, j in (("a", j1), ("b", j2)):
        rows, j = staged(rows, f"{name}j", j)
        inv, size = inverse(j)
        rows, inv = staged(rows, f"{name}i", inv)
        inverses.append(inv)
        rows = rows.withColumn(f"_{name}size", size)
        regular &= F.col(f"_{name}size") > SINGULAR**2
    a, b = inverses
    rows, left = staged(rows, "l", product(a, v))
    rows, out = staged(rows, "o", product(left, adjoint(b)))
    ok = F.coalesce(F.col("_valid") & regular & ~F.col("_flagged"), F.lit(False))
    value = lambda c: F.when(ok, c).otherwise(F.lit(0.0) if allow_flag else F.when(F.col("_flagged"), F.lit(0.0)).otherwise(F.raise_error(F.lit("a sample has no valid calibration")).cast("double")))
    columns = {}
    for p, z in enumerate(out):
        columns |= {f"v{p}_re": value(z.re), f"v{p}_im": value(z.im)}
    for p in range(4 if sigma else 0):
        terms = [(a[2 * (p // 2) + k // 2].abs2() * b[2 * (p % 2) + k % 2].abs2()) * F.col(f"_sigma{k}") * F.col(f"_sigma{k}") for k in range(4)]
        columns[f"sigma{p}"] = F.when(ok, F.sqrt(terms[0] + terms[1] + terms[2] + terms[3]))
    rows = rows.withColumns(columns | {"flag": ~ok})
    return rows.select(*[c for c in kept if c not in columns and c != "flag"], *columns, "flag")


#: Columns of a solution: gains of both receptors and leakages between them.
PARAMETERS = ("g11", "g22", "d12", "d21")


def with_solutions(rows: DataFrame, solutions: DataFrame, beam: str = "beam", chan: str = "chan", beam_independent: bool = False, channel_independent: bool = False) -> tuple[DataFrame, Matrix, Matrix, Column]:
    """(rows with both antennas' parameters, their matrices, whether both are valid).

    solutions: antenna, beam, chan, g11_re .. d21_im, valid. Beam-independent
    ones are beam 0's for every beam, channel-independent ones channel 0's for
    every channel; a sample whose antennas have no solution is not valid. Rows
    meet solutions twice, by antenna; solutions are few and Spark sends what it
    knows to be small.
    """
    keys = []
    for column, name, alike in ((beam, "beam", beam_independent), (chan, "chan", channel_independent)):
        if alike:
            solutions = solutions.where(F.col(name) == 0)
        else:
            keys.append((column, name))
    found = []
    for n, antenna in ((1, "antenna1"), (2, "antenna2")):
        own = solutions.select(F.col("antenna").alias(f"_a{n}"), *[F.col(name).alias(f"_{name}{n}") for _, name in keys], F.col("valid").alias(f"_ok{n}"), *[F.col(f"{p}_{c}").alias(f"_{p}{n}_{c}") for p in PARAMETERS for c in ("re", "im")])
        cond = F.col(antenna) == F.col(f"_a{n}")
        for column, name in keys:
            cond &= F.col(column) == F.col(f"_{name}{n}")
        rows = rows.join(own, cond, "left").drop(f"_a{n}", *[f"_{name}{n}" for _, name in keys])
        found.append(jones(*[Cx.of(f"_{p}{n}_re", f"_{p}{n}_im") for p in PARAMETERS]))
    return rows, found[0], found[1], F.coalesce(F.col("_ok1") & F.col("_ok2"), F.lit(False))


def solved_leakages(products: DataFrame, by: list[str]) -> DataFrame:
    """Leakages (by, antenna, d12, d21 as re and im) from mean cross polarisations of a source of unit flux (antenna1, antenna2, xy_re, xy_im, yx_re, yx_im).

    To first order XY is d12 of the one plus conj(d21) of the other, YX the other
    way round: linear in d12 and conj(d21). They hold but for a common offset,
    which makes d12 of the first antenna 0. Independent keys side by side.
    """
    import pandas as pd

    types = dict(products.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["antenna int", "d12_re double", "d12_im double", "d21_re double", "d21_im double"])

    def run(key, pdf):
        names = np.unique(np.concatenate([pdf["antenna1"], pdf["antenna2"]]))
        i, j = np.searchsorted(names, pdf["antenna1"]), np.searchsorted(names, pdf["antenna2"])
        n, m = len(names), len(pdf)
        a = np.zeros((2 * m, 2 * n))
        a[np.arange(m), i], a[np.arange(m), n + j] = 1, 1
        a[m + np.arange(m), n + i], a[m + np.arange(m), j] = 1, 1
        y = np.concatenate([pdf["xy_re"] + 1j * pdf["xy_im"], pdf["yx_re"] - 1j * pdf["yx_im"]])
        x = np.linalg.lstsq(a, y, rcond=1e-9)[0]
        d12, d21 = x[:n] - x[0], np.conj(x[n:] + x[0])
        return pd.DataFrame({**{b: [k] * n for b, k in zip(by, key, strict=True)}, "antenna": names.astype("int32"), "d12_re": d12.real, "d12_im": d12.imag, "d21_re": d21.real, "d21_im": d21.imag})

    return products.groupBy(*by).applyInPandas(run, schema)


def solved_ionosphere(phases: DataFrame, by: list[str]) -> DataFrame:
    """by, coeff_l, coeff_m of the first-order ionospheric phase -2 pi lambda^2 (dx l + dy m) from (dx, dy, freq, phase): two normal equations as grouped sums."""
    k = F.lit(-2 * math.pi) * F.pow(F.lit(C_LIGHT) / F.col("freq"), F.lit(2.0))
    rows = phases.select(*by, (k * F.col("dx")).alias("_a"), (k * F.col("dy")).alias("_b"), F.col("phase").alias("_p"))
    s = rows.groupBy(*by).agg(*[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in (("_a", "_a"), ("_a", "_b"), ("_b", "_b"), ("_a", "_p"), ("_b", "_p"))])
    det = F.col("_a_a") * F.col("_b_b") - F.col("_a_b") * F.col("_a_b")
    solve = lambda e: F.when(det != 0, e / det)
    return s.select(*by, solve(F.col("_b_b") * F.col("_a_p") - F.col("_a_b") * F.col("_b_p")).alias("coeff_l"), solve(F.col("_a_a") * F.col("_b_p") - F.col("_a_b") * F.col("_a_p")).alias("coeff_m"))


def jones_parameters(seen: DataFrame, solutions: DataFrame) -> DataFrame:
    """name, re, im of the parameters of every (antenna, beam) in seen; gains without a valid solution are 1, leakages 0.

    solutions have antenna, beam, kind, re, im, valid.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("unit")) for k, v in (("g11", 1.0), ("g22", 1.0), ("d12", 0.0), ("d21", 0.0))]))
    want = seen.select("antenna", "beam").distinct().select("antenna", "beam", kinds.alias("k")).select("antenna", "beam", "k.*")
    met = want.join(solutions.where("valid").select("antenna", "beam", "kind", "re", "im"), ["antenna", "beam", "kind"], "left")
    name = F.concat_ws(".", F.when(F.col("kind").startswith("g"), "gain").otherwise("leakage"), "kind", F.col("antenna").cast("string"), F.col("beam").cast("string"))
    return met.select(name.alias("name"), F.coalesce("re", "unit").alias("re"), F.when(F.col("re").isNull(), 0.0).otherwise(F.col("im")).alias("im"))


#: High-level solvers by name, an extension point: rows or products and keys in, parameters out.
SOLVERS = {"leakage": solved_leakages, "ionosphere": solved_ionosphere}


def register_solver(name: str, solve) -> None:
    SOLVERS[name] = solve
