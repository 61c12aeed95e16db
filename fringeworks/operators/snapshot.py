"""Snapshot imaging: integrations that share a plane w = a u + b v are imaged as if coplanar, then brought into one frame.

On such a plane a source at (l, m) has the phase of one at
(l + a (n - 1), m + b (n - 1)), n = sqrt(1 - l^2 - m^2): the segment's image is
the sky seen in tilted coordinates. Each segment's plane is transformed and
read at these places in one bounded task; the common image is a grouped sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from . import gridding as G
from . import images as I  # noqa: E741


def tilted(l: np.ndarray, m: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Where a source at (l, m) appears in the image of a plane w = a u + b v; not a number beyond the horizon."""
    r = 1 - l * l - m * m
    n = np.where(r >= 0, np.sqrt(np.maximum(r, 0)), np.nan)
    return l + a * (n - 1), m + b * (n - 1)


def upright(l: np.ndarray, m: np.ndarray, a: float, b: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The inverse of tilted, by its own fixed point (it contracts for |a l + b m| well under n)."""
    x, y = l.copy(), m.copy()
    for _ in range(rounds):
        d = np.sqrt(np.maximum(1 - x * x - y * y, 0)) - 1
        x, y = l - a * d, m - b * d
    return x, y


def reprojected(image: np.ndarray, cell: float, a: float, b: float, method: str = "cubic", into: bool = True) -> np.ndarray:
    """An image (pixels of 1 / (size * cell)) brought from its plane into the common frame, or, with into false, the other way (for degridding)."""
    n = len(image)
    if method is None or (a == 0 and b == 0):
        return image
    x, y = np.indices(image.shape)
    l, m = (x - n // 2) / (n * cell), (y - n // 2) / (n * cell)  # noqa: E741
    p, q = tilted(l, m, a, b) if into else upright(l, m, a, b)
    there = np.isfinite(p) & np.isfinite(q)
    out = I.regrid(image, np.where(there, p, 0) * n * cell + n // 2, np.where(there, q, 0) * n * cell + n // 2, method)
    return np.where(there, out, 0.0)


def segmented(samples: DataFrame, by: list[str], tolerance: float, restart: float) -> DataFrame:
    """samples with segment (a text, unique within by), a, b and rest, what the plane leaves of w.

    Planes are fitted to sums per integration and never outlast restart
    seconds, so that no dataset is one task.
    """
    block = F.floor(F.col("time_s") / restart).alias("_block")
    s = samples.withColumn("_block", block)
    planes = I.snapshot_segments(s, [*by, "_block"], tolerance).select(*by, "_block", "time_s", F.concat_ws(".", "_block", "segment").alias("segment"), "a", "b")
    return s.join(planes, [*by, "_block", "time_s"]).drop("_block").withColumn("rest", F.col("w") - F.col("a") * F.col("u") - F.col("b") * F.col("v"))


def snapshot_image(samples: DataFrame, kernel: G.Kernel, by: list[str], n: int, cell: float, weight: Column, method: str | None = "cubic", correct: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """by, x, y, value, weight: images of segmented samples (with plane, fracu, fracv, iu, iv) in one frame, divided by the sum of weights.

    Without a method the segments are added as they are.
    """
    keys = [*by, "segment", "a", "b"]
    cells = G.gridded(samples, kernel, Cx.of("re", "im").conj(), weight, keys, psf=False)
    types = dict(samples.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["x int, y int, value double, weight double"])

    def run(key, pdf):
        import pandas as pd

        image = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(G.dense(pdf, n)))).real * n * n
        image = reprojected(G.tapered(image, correct), cell, key[-2], key[-1], method)
        x, y = np.indices((n, n))
        return pd.DataFrame({**{k: [v] * n * n for k, v in zip(by, key, strict=False)}, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "value": image.ravel(), "weight": float(pdf["weight"].sum())})

    planes = cells.groupBy(*keys).applyInPandas(run, schema)
    return planes.groupBy(*by, "x", "y").agg((F.sum("value") / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))
