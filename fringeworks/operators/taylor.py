"""Imaging with Taylor terms of frequency: all equations of a cycle from one pass over the samples.

A sample adds to its cells its residual times x^t for each term t, its weight
times x^t for each of the 2 T - 1 point-spread functions, and the plain weight
of the preconditioner function, x being (freq - f0) / f0. All are columns of
one grouped sum: one shuffle of partial sums, whatever the number of terms. The
minor cycle works on a plane's own images, side by side over keys, and the
models, bounded by their shape, are checkpointed between cycles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from ..sources.store import shared_dir
from . import cycle as Y
from . import deconv as D
from . import gridding as G


def offset(freq, f0: float) -> Column:
    """x of a frequency: its relative distance from the reference."""
    return F.col(freq) / f0 - 1 if isinstance(freq, str) else freq / f0 - 1


def powers(x: Column, n: int) -> list[Column]:
    out, p = [], F.lit(1.0)
    for _ in range(n):
        out.append(p)
        p = p * x
    return out


def equations(samples: DataFrame, kernel: G.Kernel, value: Cx, x: Column, weight: Column, keys: list[str], terms: int) -> DataFrame:
    """Cells (keys, gu, gv): r{t}_re, r{t}_im of the residuals, p{t}_re, p{t}_im of the point-spread functions, pcf.

    samples have plane, fracu, fracv, iu, iv. A box is its own cell; other
    kernels are joined by one key, before the sums.
    """
    s = samples.select(*keys, "plane", "fracu", "fracv", "iu", "iv", value.re.alias("_re"), value.im.alias("_im"), x.alias("_x"), weight.alias("_w"))
    if kernel.is_box:
        s = s.where("plane = 0 AND fracu = 0 AND fracv = 0").withColumnsRenamed({"iu": "gu", "iv": "gv"})
        k = Cx.of(F.lit(1.0))
    else:
        s = G._with_kernel(s, kernel).withColumns({"gu": F.col("iu") + F.col("du"), "gv": F.col("iv") + F.col("dv")})
        k = Cx.of("wt_re", "wt_im")
    p = powers(F.col("_x"), 2 * terms - 1)
    unit, v = k * F.col("_w"), k * F.col("_w") * Cx.of("_re", "_im")
    sums = [F.sum(c * p[t]).alias(f"r{t}_{n}") for t in range(terms) for n, c in (("re", v.re), ("im", v.im))]
    sums += [F.sum(c * p[t]).alias(f"p{t}_{n}") for t in range(2 * terms - 1) for n, c in (("re", unit.re), ("im", unit.im))]
    return s.groupBy(*keys, "gu", "gv").agg(*sums, F.sum("_w").alias("pcf"))


def images(cells: DataFrame, keys: list[str], n: int, terms: int, correct=None) -> DataFrame:
    """keys, x, y, dirty0.., psf0.. (2 T - 1), pcf: transforms of the cells of equations; pcf stays on its cells."""
    planes = {f"dirty{t}": (f"r{t}_re", f"r{t}_im") for t in range(terms)} | {f"psf{t}": (f"p{t}_re", f"p{t}_im") for t in range(2 * terms - 1)}
    out = G.images_of(cells, keys, n, planes, correct)
    return out.join(cells.select(*keys, F.col("gu").alias("x"), F.col("gv").alias("y"), "pcf"), [*keys, "x", "y"], "left").fillna(0.0, ["pcf"])


def predicted(samples: DataFrame, models: DataFrame, kernel: G.Kernel, x: Column, n: int, keys: list[str], terms: int, correct=None) -> DataFrame:
    """samples with m_re, m_im: the sum over terms of x^t times the visibility of model{t}, looked up by cell once for all terms."""
    schema = ", ".join([f"{k} {dict(models.dtypes)[k]}" for k in keys] + ["gu int, gv int"] + [f"g{t}_{p} double" for t in range(terms) for p in ("re", "im")])

    def run(key, pdf):
        import pandas as pd

        u, v = np.indices((n, n))
        out = {**dict(zip(keys, ([k] * n * n for k in key), strict=True)), "gu": u.ravel().astype("int32"), "gv": v.ravel().astype("int32")}
        for t in range(terms):
            image = np.zeros((n, n))
            image[pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf[f"model{t}"].to_numpy()
            z = G.grid_of(image, correct)
            out |= {f"g{t}_re": z.real.ravel(), f"g{t}_im": z.imag.ravel()}
        return pd.DataFrame(out)

    grid = models.groupBy(*keys).applyInPandas(run, schema)
    at = [*keys, "plane", "fracu", "fracv", "iu", "iv"]
    bins = samples.select(*at).distinct()
    if kernel.is_box:
        bins = bins.where("plane = 0 AND fracu = 0 AND fracv = 0").withColumns({"gu": F.col("iu"), "gv": F.col("iv")})
        k = Cx.of(F.lit(1.0))
    else:
        bins = G._with_kernel(bins, kernel).withColumns({"gu": F.col("iu") + F.col("du"), "gv": F.col("iv") + F.col("dv")})
        k = Cx.of("wt_re", "wt_im")
    values = {f"g{t}": k * Cx.of(f"g{t}_re", f"g{t}_im").conj() for t in range(terms)}
    found = bins.join(grid, [*keys, "gu", "gv"]).groupBy(*at).agg(*[F.sum(c).alias(f"_{name}_{p}") for name, z in values.items() for p, c in (("re", z.re), ("im", z.im))])
    p = powers(x, terms)
    whole = lambda part: sum((F.coalesce(F.col(f"_g{t}_{part}"), F.lit(0.0)) * p[t] for t in range(1, terms)), F.coalesce(F.col(f"_g0_{part}"), F.lit(0.0)))
    out = samples.join(found, at, "left").withColumns({"m_re": whole("re"), "m_im": whole("im")})
    return out.drop(*[c for c in out.columns if c.startswith("_g")])


def _minor(keys: list[str], n: int, terms: int, control: Callable[[], D.Control] | None, scales: list[float], criterion: str, stop: float):
    import pandas as pd

    def run(key, pdf):
        a = {}
        for c in [*(f"dirty{t}" for t in range(terms)), *(f"psf{t}" for t in range(2 * terms - 1)), *(f"model{t}" for t in range(terms))]:
            a[c] = np.zeros((n, n))
            a[c][pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf[c].to_numpy()
        top = a["psf0"][n // 2, n // 2]
        share = 1 / top if top > 0 else 0.0
        dirty, psf = [a[f"dirty{t}"] * share for t in range(terms)], [a[f"psf{t}"] * share for t in range(2 * terms - 1)]
        peak, model = float(np.abs(dirty[0]).max()), [a[f"model{t}"] for t in range(terms)]
        if control and peak > stop and share:
            model = [m + c for m, c in zip(model, D.multi_term(dirty, psf, scales, control(), criterion)[0], strict=True)]
        x, y = np.indices((n, n))
        return pd.DataFrame({**{k: [v] * n * n for k, v in zip(keys, key, strict=True)}, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), **{f"model{t}": model[t].ravel() for t in range(terms)}, "residual": dirty[0].ravel(), "peak": peak})

    return run


def cycles(samples: DataFrame, kernel: G.Kernel, n: int, keys: list[str], freq: str, f0: float, weight: Column, terms: int, rounds: int, control: Callable[[], D.Control], scales: list[float] | None = None, criterion: str = "MAXBASE", stop: float = 0.0, correct=None) -> tuple[DataFrame, DataFrame]:
    """(keys, cycle, peak; keys, x, y, model0.., residual): predict, subtract, all equations in one pass, clean all terms, again.

    A cycle more than rounds is run without cleaning: its residual is what the last model leaves.
    Samples are read once and summed into bins of one cell, step and frequency,
    which are checkpointed; every cycle is one pass over the bins.
    """
    context = samples.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(samples.sparkSession))
    schema = ", ".join([f"{k} {dict(samples.dtypes)[k]}" for k in keys] + ["x int, y int"] + [f"model{t} double" for t in range(terms)] + ["residual double, peak double"])
    state, log, names = None, None, [f"model{t}" for t in range(terms)]
    samples, weight = Y.binned(samples, keys, weight, (freq,)).checkpoint(), F.col("_wt")
    for cycle in range(rounds + 1):
        rows = samples
        if state is not None:
            rows = predicted(samples, state.select(*keys, "x", "y", *names), kernel, offset(freq, f0), n, keys, terms, correct)
            rows = rows.withColumns({"re": F.col("re") - F.col("m_re"), "im": F.col("im") - F.col("m_im")})
        cells = equations(rows, kernel, Cx.of("re", "im").conj(), offset(freq, f0), weight, keys, terms)
        planes = images(cells, keys, n, terms, correct)
        planes = planes.withColumns({m: F.lit(0.0) for m in names}) if state is None else planes.join(state.select(*keys, "x", "y", *names), [*keys, "x", "y"])
        state = planes.groupBy(*keys).applyInPandas(_minor(keys, n, terms, None if cycle == rounds else control, scales or [0.0], criterion, stop), schema).checkpoint()
        one = state.groupBy(*keys).agg(F.lit(cycle).alias("cycle"), F.max("peak").alias("peak"))
        log = one if log is None else log.unionByName(one)
    return log, state.drop("peak")


def spectral_index(model: DataFrame, least: float) -> DataFrame:
    """model (model0, model1, ...) with alpha (and beta, given a third term) where the flux is at least least, else null."""
    bright = F.col("model0") >= least
    alpha = F.col("model1") / F.col("model0")
    out = model.withColumn("alpha", F.when(bright, alpha))
    if "model2" in model.columns:
        out = out.withColumn("beta", F.when(bright, F.col("model2") / F.col("model0") - alpha * (alpha - 1) / 2))
    return out
