"""A-projection with a w stack: kernels keyed by field, feed, epoch and frequency, a grid for every w plane.

A kernel holds while the pointing and the parallactic angle of its field and
feed move by no more than a tolerance from one integration to the next, and for
one band of frequencies. Kernels are made in tasks, from the distinct keys that
the samples have. Up to KERNEL_ROWS cells of them, which are counted, go to the
tasks as arrays; more meet the samples in a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from ..functions.scalar import C_LIGHT
from ..sources.store import shared_dir
from . import gridding as G
from . import illumination as L
from . import joins as J
from . import ordered as O  # noqa: E741

KEYS = ("field_id", "feed", "epoch", "band")


def with_epochs(samples: DataFrame, pointing: float, angle: float, bucket: float, keys: tuple[str, str] = ("field_id", "feed")) -> DataFrame:
    """samples (field_id, feed, time_s, l, m, pa) with epoch: it changes when l or m moves by more than pointing, or pa by more than angle.

    One row an integration is put in order, not the samples; they look up the
    last epoch that begins at or before them. Those without a key or time are left out.
    """
    context = samples.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(samples.sparkSession))
    samples = samples.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "time_s")]))
    own = samples.groupBy(*keys, "time_s").agg(F.avg("l").alias("l"), F.avg("m").alias("m"), F.avg("pa").alias("pa")).checkpoint()
    i = O.islands(own, list(keys), ["time_s"], F.floor(F.col("time_s") / bucket), [("l", pointing), ("m", pointing), ("pa", angle)])
    begins = i.groupBy(*keys, F.col("island").alias("epoch")).agg(F.min("time_s").alias("_begins"))
    return J.asof(samples, begins, {k: k for k in keys}, "time_s", "_begins", ["epoch"]).drop("_begins")


def with_bands(samples: DataFrame, width: float, freq: str = "freq") -> DataFrame:
    """samples with band: frequencies that share a kernel."""
    return samples.withColumn("band", F.floor(F.col(freq) / width).cast("int"))


def kernels(samples: DataFrame, pattern: Callable[[float], np.ndarray], cell: float, support: int, oversample: int) -> DataFrame:
    """KEYS, fracu, fracv, du, dv, wt_re, wt_im for the keys that samples have.

    pattern gives the illumination at a wavelength, in cells of the aperture
    (metres). A key's pointing, angle and frequency are its samples' means. The
    pattern is turned by the angle and looks at the pointing.
    """
    keys = samples.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in ("l", "m", "pa", "freq")])
    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in KEYS) + ", fracu int, fracv int, du int, dv int, wt_re double, wt_im double"

    def run(it):
        import pandas as pd

        for pdf in it:
            for r in pdf.itertuples(index=False):
                wavelength = C_LIGHT / r.freq
                p = L.offset(L.rotated(pattern(wavelength), r.pa), cell, r.l, r.m, wavelength)
                own = pd.DataFrame(L.a_kernel_rows({0: p}, support, oversample), columns=["plane", "fracu", "fracv", "du", "dv", "wt_re", "wt_im"]).drop(columns="plane")
                yield own.assign(**{k: getattr(r, k) for k in KEYS})[[x.split()[0] for x in schema.split(", ")]]

    # few rows, much work each: as many tasks as there are cores at least
    n = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), samples.sparkSession.sparkContext.defaultParallelism)
    return keys.repartition(n, *KEYS).mapInPandas(run, schema)


def _by_cell(samples: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of samples (_re, _im, _w) that are joined with each cell of their kernel."""
    j = samples.join(table, [*KEYS, "fracu", "fracv"])
    k = Cx.of("wt_re", "wt_im") * F.col("_w")
    v = k * Cx.of("_re", "_im")
    return j.groupBy(*keys, (F.col("iu") + F.col("du")).alias("gu"), (F.col("iv") + F.col("dv")).alias("gv")).agg(F.sum(v.re).alias("re"), F.sum(v.im).alias("im"), F.sum(k.re).alias("weight"))


def gridded(samples: DataFrame, table: DataFrame, value: Cx, weight: Column, keys: list[str], small: int = G.KERNEL_ROWS) -> DataFrame:
    """Cells (keys, gu, gv, re, im, weight) of samples with KEYS, fracu, fracv, iu, iv; keys hold the w plane.

    At most small rows of kernels go to the tasks as arrays: a sample finds the
    number of its kernel, and a batch leaves a row a cell. More are joined.
    A sample without a visibility counts in the weight only.
    """
    own = dict.fromkeys([*keys, *KEYS, "fracu", "fracv", "iu", "iv"])
    s = samples.select(*own, value.re.alias("_re"), value.im.alias("_im"), weight.alias("_w"))
    if (few := J._few(table.select(*KEYS, "fracu", "fracv", "du", "dv", "wt_re", "wt_im"), small)) is None:
        return _by_cell(s, table, keys)
    spark = samples.sparkSession
    few = few.combine_chunks()
    owners = few.select(list(KEYS)).group_by(list(KEYS)).aggregate([])
    number = owners.append_column("plane", pa.array(np.arange(owners.num_rows, dtype=np.int32)))
    cells = few.join(number, list(KEYS)).select([x.split()[0] for x in G.KERNEL_SCHEMA.split(", ")])
    s = s.join(F.broadcast(spark.createDataFrame(number, ", ".join(f"{k} {dict(table.dtypes)[k]}" for k in KEYS) + ", plane int")), list(KEYS))
    # what a sample lacks: nothing, a visibility, a weight
    s = s.withColumn("_lacks", F.when(F.col("_w").isNull(), 2).when(F.col("_re").isNull() | F.col("_im").isNull(), 1).otherwise(0))
    s = s.withColumns({"_re": F.when(F.col("_lacks") == 0, F.col("_re")).otherwise(0.0), "_im": F.when(F.col("_lacks") == 0, F.col("_im")).otherwise(0.0), "_w": F.coalesce("_w", F.lit(0.0))})
    g = G.gridded(s, G.Kernel(spark, cells), Cx.of("_re", "_im"), F.col("_w"), [*keys, "_lacks"], psf=False)
    seen = lambda c, most: F.sum(F.when(F.col("_lacks") <= most, F.col(c))).alias(c)
    return g.groupBy(*keys, "gu", "gv").agg(seen("re", 0), seen("im", 0), seen("weight", 1))


def stacked_image(cells: DataFrame, plane: str, w_of: Callable[[int], float], keys: list[str], n: int, cell: float) -> DataFrame:
    """keys, x, y, value: each w plane's cells transformed, turned by its screen over an image of 1 / cell radians, and added."""
    types = dict(cells.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["x int, y int, value double"])

    def run(key, pdf):
        import pandas as pd

        z = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(G.dense(pdf, n)))) * n * n
        x, y = np.indices((n, n))
        l, m = (x - n // 2) / (n * cell), (y - n // 2) / (n * cell)  # noqa: E741
        r = np.minimum(l * l + m * m, 1.0)
        z = (z * np.exp(2j * math.pi * w_of(int(key[-1])) * (np.sqrt(1 - r) - 1))).real
        return pd.DataFrame({**{k: [v] * n * n for k, v in zip(keys, key, strict=False)}, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "value": z.ravel()})

    planes = cells.groupBy(*keys, plane).applyInPandas(run, schema)
    return planes.groupBy(*keys, "x", "y").agg(F.sum("value").alias("value"))
