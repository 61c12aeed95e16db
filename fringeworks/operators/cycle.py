"""Prediction of components and the major cycle: predict, subtract, grid the residual, transform, clean, again."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..sources.store import shared_dir
from . import deconv as D
from . import gridding as G


def _point(c: dict) -> Cx:
    return S.point_source("freq", "u", "v", "w", c["flux"], c["l"], c["m"], c.get("alpha", 0.0), c.get("f0", 1.0))


def _gaussian(c: dict) -> Cx:
    return _point(c) * S.gaussian_taper("freq", "u", "v", c["bmaj"], c["bmin"], c["bpa"])


#: Sky components by kind, an extension point: a component's numbers in, its visibility over (u, v, w, freq) out.
COMPONENTS: dict[str, Callable[[dict], Cx]] = {"point": _point, "gaussian": _gaussian}
#: Called in order with the predicted visibilities (a frame with m_re, m_im) before they are subtracted.
VISIBILITY_HOOKS: list[Callable[[DataFrame], DataFrame]] = []
STOKES = ("I", "Q", "U", "V")


def stokes_index(stokes: str) -> Column:
    """0 to 3 for I, Q, U, V; anything else is an error of the job."""
    c = F.upper(F.trim(F.col(stokes)))
    return F.when(c.isin(*STOKES), F.array_position(F.array(*map(F.lit, STOKES)), c) - 1).otherwise(F.raise_error(F.concat(F.lit("not a Stokes parameter: "), c))).cast("int")


def predicted(components: Iterable[dict], stokes: str | None = None) -> Cx:
    """Summed visibilities of unpolarised components as one expression over a row: no join. With stokes, 0 for all but I."""
    z = reduce(lambda a, b: a + b, [COMPONENTS[c.get("kind", "point")](c) for c in components], Cx.of(0.0))
    if stokes is None:
        return z
    own = stokes_index(stokes) == 0
    return Cx(F.when(own, z.re).otherwise(0.0), F.when(own, z.im).otherwise(0.0))


def model_subtracted(vis: DataFrame, components: Iterable[dict]) -> DataFrame:
    """Continuum subtraction: re and im less the components' visibilities."""
    z = predicted(components)
    return vis.withColumns({"re": F.col("re") - z.re, "im": F.col("im") - z.im})


def predicted_from(samples: DataFrame, model: DataFrame, kernel: G.Kernel, n: int, keys: list[str], correct=None) -> DataFrame:
    """samples with m_re, m_im: visibilities of model images (keys, x, y, value), degridded from their transforms; 0 without a model."""
    grid = G.grids_of(model, keys, n, "value", correct)
    at = [*keys, "plane", "fracu", "fracv", "iu", "iv"]
    found = G.degridded(samples.select(*at).distinct(), kernel, grid, keys, at).withColumnsRenamed({"re": "m_re", "im": "m_im"})
    out = samples.join(found, at, "left").fillna(0.0, ["m_re", "m_im"])
    return reduce(lambda df, hook: hook(df), VISIBILITY_HOOKS, out)


def binned(samples: DataFrame, keys: list[str], weight: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """samples with one row a bin (keys, plane, fracu, fracv, iu, iv, also): the weighted mean of re, im, and the sum of weights as _wt.

    Samples of one bin see one model value and one kernel, so the sums of their
    residuals are those of the mean. Rows without a visibility are bins of their own.
    """
    at = [*keys, "plane", "fracu", "fracv", "iu", "iv", *also]
    whole = F.col("_re").isNotNull() & F.col("_im").isNotNull()
    s = samples.select(*at, F.col("re").alias("_re"), F.col("im").alias("_im"), weight.cast("double").alias("_w")).withColumn("_whole", whole)
    sums = s.groupBy(*at, "_whole").agg(F.sum("_w").alias("_wt"), *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in ("_re", "_im")])
    mean = lambda c: F.when(F.col("_whole"), F.when(F.col("_wt") == 0, 0.0).otherwise(F.col(c) / F.col("_wt")))
    return sums.select(*at, mean("_re").alias("re"), mean("_im").alias("im"), "_wt")


def _minor_cycle(keys: list[str], n: int, minor: Callable[[], D.Control] | None, stop: float, border: int):
    """Cleans a plane (dirty, psf, model) of pixels; without minor it only tells the residual. The border is not searched."""
    import pandas as pd

    def run(key, pdf):
        a = {}
        for c in ("dirty", "psf", "model"):
            a[c] = np.zeros((n, n))
            a[c][pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf[c].to_numpy()
        top = a["psf"][n // 2, n // 2]
        dirty, psf = (a["dirty"] / top, a["psf"] / top) if top > 0 else (a["dirty"] * 0, a["psf"])
        inner = np.zeros((n, n))
        inner[border : n - border, border : n - border] = 1
        peak, model = float(np.abs(dirty * inner).max()), a["model"]
        if minor and peak > stop:
            model = model + D.hogbom(dirty, psf, minor(), inner)[0]
        x, y = np.indices((n, n))
        return pd.DataFrame({**{k: [v] * n * n for k, v in zip(keys, key, strict=True)}, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "model": model.ravel(), "residual": dirty.ravel(), "peak": peak})

    return run


def major_cycles(samples: DataFrame, kernel: G.Kernel, n: int, keys: list[str], weight: Column, cycles: int, minor: Callable[[], D.Control], stop: float = 0.0, correct=None, border: int = 0) -> tuple[DataFrame, DataFrame]:
    """(keys, cycle, peak, flux: largest residual before each cycle's clean and flux of the model after it; keys, x, y, model, residual at the end).

    samples have plane, fracu, fracv, iu, iv, re, im. They are read once and summed
    into bins, which are checkpointed, and every cycle is one pass over the bins;
    VISIBILITY_HOOKS may look at a sample's columns, so with hooks it is one over
    the samples. The model planes, which are bounded, are checkpointed between cycles. Planes whose residual is at most stop are cleaned no more. Pixels
    within border of the edge, where a kernel's correction blows up, are not searched.
    """
    state, log = None, None
    context = samples.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(samples.sparkSession))
    schema = ", ".join(f"{k} {dict(samples.dtypes)[k]}" for k in keys) + ", x int, y int, model double, residual double, peak double"
    if not VISIBILITY_HOOKS:
        samples, weight = binned(samples, keys, weight).checkpoint(), F.col("_wt")
    for cycle in range(cycles + 1):
        rows = samples
        if state is not None:
            rows = predicted_from(samples, state.select(*keys, "x", "y", F.col("model").alias("value")), kernel, n, keys, correct).withColumns({"re": F.col("re") - F.col("m_re"), "im": F.col("im") - F.col("m_im")})
        grid = G.gridded(rows, kernel, Cx.of("re", "im").conj(), weight, keys)
        planes = G.images_of(grid, keys, n, {"dirty": ("re", "im"), "psf": ("psf_re", "psf_im")}, correct)
        planes = planes.withColumn("model", F.lit(0.0)) if state is None else planes.join(state.select(*keys, "x", "y", "model"), [*keys, "x", "y"])
        state = planes.groupBy(*keys).applyInPandas(_minor_cycle(keys, n, None if cycle == cycles else minor, stop, border), schema).checkpoint()
        one = state.groupBy(*keys).agg(F.lit(cycle).alias("cycle"), F.max("peak").alias("peak"), F.sum("model").alias("flux"))
        log = one if log is None else log.unionByName(one)
    return log, state.drop("peak")
