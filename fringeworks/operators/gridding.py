"""Gridding and degridding as joins with a kernel table and grouped sums.

A kernel is a table (plane, fracu, fracv, du, dv, wt_re, wt_im) of fixed size:
(2 support + 1)^2 cells for every oversampling step and plane. Its size is
known when it is built, so it is broadcast only under KERNEL_ROWS; larger ones
are joined by key. Cells are summed where the samples lie before they move.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from ..functions.scalar import spheroidal_value

KERNEL_SCHEMA = "plane int, fracu int, fracv int, du int, dv int, wt_re double, wt_im double"
#: A row is some 40 bytes; beyond this the kernel is shuffled instead of sent.
KERNEL_ROWS = 500_000


def box_kernel() -> list[tuple]:
    return [(0, 0, 0, 0, 0, 1.0, 0.0)]


def spheroidal_kernel(support: int = 3, oversample: int = 8) -> list[tuple]:
    """Separable (1 - nu^2) * spheroidal(nu), normalised to unit sum for every step."""
    rows = []
    for fu in range(oversample):
        for fv in range(oversample):
            line = []
            for f in (fu, fv):
                nu = [(d + f / oversample) / (support + 1) for d in range(-support, support + 1)]
                line.append([(1 - min(1.0, x * x)) * spheroidal_value(x) for x in nu])
            total = sum(line[0]) * sum(line[1])
            rows += [(0, fu, fv, i - support, j - support, a * b / total, 0.0) for i, a in enumerate(line[0]) for j, b in enumerate(line[1]) if a * b]
    return rows


def w_kernels(cell: float, n_planes: int, w_max: float, support: int = 5, oversample: int = 4, size: int = 64, cutoff: float = 1e-3) -> list[tuple]:
    """W-projection: per plane, the transform of the phase screen times the taper; cells under cutoff of the peak are left out.

    cell is in wavelengths; the image spans 1 / cell radians.
    """
    rows = []
    big = size * oversample
    x = (np.arange(size) - size // 2) / (size * cell)
    taper = np.array([max(0.0, 1 - (2 * i / size) ** 2) * spheroidal_value(abs(2 * i / size)) for i in range(-(size // 2), size - size // 2)])
    l, m = np.meshgrid(x, x, indexing="ij")  # noqa: E741
    r2 = np.minimum(l * l + m * m, 1.0)
    for plane in range(n_planes):
        w = 0.0 if n_planes == 1 else w_max * (2 * plane / (n_planes - 1) - 1)
        screen = np.exp(-2j * math.pi * w * (1 - np.sqrt(1 - r2))) * np.outer(taper, taper)
        padded = np.zeros((big, big), complex)
        at = (big - size) // 2
        padded[at : at + size, at : at + size] = screen
        k = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(padded)))
        c = big // 2
        floor = cutoff * np.abs(k).max()
        for fu in range(oversample):
            for fv in range(oversample):
                own = np.array([[k[c + du * oversample + fu, c + dv * oversample + fv] for dv in range(-support, support + 1)] for du in range(-support, support + 1)])
                total = own.real.sum()
                rows += [(plane, fu, fv, i - support, j - support, float(z.real / total), float(z.imag / total)) for (i, j), z in np.ndenumerate(own) if abs(z) >= floor]
    return rows


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of int, double and string columns as a local relation: no tasks, and Spark knows the size, so that it broadcasts what is small by itself."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]), schema)


class Kernel:
    """Kernel rows (tuples, or an Arrow table of the same columns), as a table to join with and as dense arrays for Arrow batches."""

    def __init__(self, spark: SparkSession, rows: list[tuple] | pa.Table):
        self.spark, self.rows = spark, rows
        #: One cell of weight 1 for plane 0: nothing to look up.
        self.is_box = not isinstance(rows, pa.Table) and [tuple(map(float, r)) for r in rows] == [(0, 0, 0, 0, 0, 1, 0)]
        self.is_small = len(rows) <= KERNEL_ROWS

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, KERNEL_SCHEMA) if isinstance(self.rows, pa.Table) else local_rows(self.spark, self.rows, KERNEL_SCHEMA)

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """(plane, fracu, fracv, du, dv of each row, its weight)."""
        if isinstance(self.rows, pa.Table):
            c = [x.to_numpy() for x in self.rows.columns]
            return np.stack(c[:5], 1).astype(np.int64), c[5] + 1j * c[6]
        return np.array([r[:5] for r in self.rows], np.int64).reshape(-1, 5), np.array([complex(r[5], r[6]) for r in self.rows])

    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of each plane and step or -1, weights by row and cell, which cells are there, (du, dv) of the cells)."""
        whole, weight = self.columns()
        keys, at = np.unique(whole[:, :3], axis=0, return_inverse=True)
        cells, cell = np.unique(whole[:, 3:], axis=0, return_inverse=True)
        lookup = np.full(whole[:, :3].max(axis=0, initial=0) + 1, -1, np.int64)
        lookup[tuple(keys.T)] = np.arange(len(keys))
        table, there = np.zeros((len(keys), len(cells)), complex), np.zeros((len(keys), len(cells)), bool)
        table[at.ravel(), cell.ravel()], there[at.ravel(), cell.ravel()] = weight, True
        return lookup, table, there, cells


def kernel_table(spark: SparkSession, rows: list[tuple]) -> Kernel:
    return Kernel(spark, rows)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files are fewer: one large row group would be one task's."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


#: Name -> maker of kernel rows: the extension point for other gridders.
KERNELS: dict[str, Callable[..., list[tuple]]] = {"box": box_kernel, "spheroidal": spheroidal_kernel, "w-projection": w_kernels}


def register_kernel(name: str, make: Callable[..., list[tuple]]) -> None:
    KERNELS[name] = make


def _with_kernel(samples: DataFrame, kernel: Kernel) -> DataFrame:
    """Samples joined with their kernel cells by one whole-number key: Spark's quickest hash table."""
    key = (F.col("plane").cast("long") * 1024 + F.col("fracu")) * 1024 + F.col("fracv")
    cells = kernel.frame().select(key.alias("_kernel"), "du", "dv", "wt_re", "wt_im")
    return samples.withColumn("_kernel", key).join(cells, "_kernel").drop("_kernel")


_SUMS = ("re", "im", "psf_re", "psf_im", "weight")
#: Additions of a batch of samples that NumPy makes at once.
ADDITIONS = 1 << 20


def _batch_sums(kernel: Kernel, keys: list[str], schema: str):
    """Arrow batches of samples (keys, plane, fracu, fracv, iu, iv, _re, _im, _wt) summed over their cells: a batch leaves a row for each cell that it touches."""
    lookup, table, there, cells = kernel.dense()
    n_keys, shape = len(keys), np.array(lookup.shape)

    def sums(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(distinct places, the values' sums there)."""
        low = int(at.min())
        width = int(at.max()) - low + 1
        if width <= 4 * len(at):
            n = np.bincount(at - low, minlength=width)
            hit = np.flatnonzero(n)
            return hit + low, [np.bincount(at - low, v, width)[hit] for v in values]
        hit, inverse = np.unique(at, return_inverse=True)
        return hit, [np.bincount(inverse, v, len(hit)) for v in values]

    def run(it):
        for whole in it:
            for lo in range(0, whole.num_rows, max(1, ADDITIONS // max(1, len(cells)))):
                b = whole.slice(lo, max(1, ADDITIONS // max(1, len(cells))))
                code = np.zeros(b.num_rows, np.int64)
                for i in range(n_keys):
                    d = b.column(i).dictionary_encode(null_encoding="encode")
                    code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
                _, first, code = np.unique(code, return_index=True, return_inverse=True)
                place = np.stack([b.column(n_keys + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
                known = ((place >= 0) & (place < shape)).all(1)
                row = np.full(b.num_rows, -1, np.int64)
                row[known] = lookup[tuple(place[known].T)]
                s = np.flatnonzero(row >= 0)
                if not len(s):
                    continue
                iu, iv = (b.column(n_keys + i).to_numpy(zero_copy_only=False).astype(np.int64)[s] for i in (3, 4))
                re, im, wt = (b.column(n_keys + i).to_numpy(zero_copy_only=False)[s] for i in (5, 6, 7))
                gu, gv = iu[:, None] + cells[None, :, 0], iv[:, None] + cells[None, :, 1]
                u0, v0 = int(gu.min()), int(gv.min())
                nu, nv = int(gu.max()) - u0 + 1, int(gv.max()) - v0 + 1
                k = table[row[s]] * wt[:, None]
                v = (re + 1j * im)[:, None] * k
                on = there[row[s]].ravel()
                at = ((code.ravel()[s][:, None] * nu + gu - u0) * nv + gv - v0).ravel()[on]
                hit, out = sums(at, [x.ravel()[on] for x in (v.real, v.imag, k.real, k.imag, k.real)])
                of = pa.array(first[hit // (nu * nv)])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(n_keys)), pa.array((hit // nv % nu + u0).astype(np.int32)), pa.array((hit % nv + v0).astype(np.int32)), *(pa.array(x) for x in out)], [*keys, "gu", "gv", *_SUMS])

    return run


def gridded(samples: DataFrame, kernel: Kernel, value: Cx, weight: Column, keys: list[str], psf: bool = True) -> DataFrame:
    """Sums over cells (keys, gu, gv): visibility, unit response and weights in one pass.

    samples have plane, fracu, fracv, iu, iv. One shuffle, of partial sums.
    Kernels of up to KERNEL_ROWS rows go to the tasks as arrays, and a batch of
    samples leaves one row a cell; larger ones are joined. A box needs neither.
    """
    s = samples.withColumns({"_re": value.re, "_im": value.im, "_wt": weight}).select(*keys, "plane", "fracu", "fracv", "iu", "iv", "_re", "_im", "_wt")
    names = [n for n in _SUMS if psf or not n.startswith("psf")]
    if kernel.is_small:
        types = dict(s.dtypes)
        schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["gu int, gv int"] + [f"{n} double" for n in _SUMS])
        full = s.where("_re IS NOT NULL AND _im IS NOT NULL AND _wt IS NOT NULL").select(*keys, "plane", "fracu", "fracv", "iu", "iv", *[F.col(c).cast("double").alias(c) for c in ("_re", "_im", "_wt")])
        cells = full.mapInArrow(_batch_sums(kernel, keys, schema), schema)
        return cells.groupBy(*keys, "gu", "gv").agg(*[F.sum(n).alias(n) for n in names])
    if kernel.is_box:
        j = s.where("plane = 0 AND fracu = 0 AND fracv = 0").select(*keys, F.col("iu").alias("gu"), F.col("iv").alias("gv"), "_re", "_im", "_wt")
        k = Cx.of("_wt")
    else:
        j = _with_kernel(s, kernel).withColumns({"gu": F.col("iu") + F.col("du"), "gv": F.col("iv") + F.col("dv")})
        k = Cx.of("wt_re", "wt_im") * F.col("_wt")
    v = Cx.of("_re", "_im") * k
    columns = dict(zip(_SUMS, (v.re, v.im, k.re, k.im, k.re), strict=True))
    return j.groupBy(*keys, "gu", "gv").agg(*[F.sum(columns[n]).alias(n) for n in names])


def degridded(samples: DataFrame, kernel: Kernel, grid: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """For each sample, the sum over its cells of kernel * conj(grid).

    Samples of one cell and step get one value, so the fan-out is over distinct
    bins and the samples only look theirs up; a box looks up its cell itself. A
    sample without any cell is left out.
    """
    at = [*keys, "plane", "fracu", "fracv", "iu", "iv"]
    if kernel.is_box:
        cells = grid.select(*keys, F.col("gu").alias("iu"), F.col("gv").alias("iv"), F.col("re").alias("_g_re"), (-F.col("im")).alias("_g_im"))
        own = samples.where("plane = 0 AND fracu = 0 AND fracv = 0").select(*dict.fromkeys([*row, *keys, "iu", "iv"]))
        return own.join(cells, [*keys, "iu", "iv"]).select(*row, F.col("_g_re").alias("re"), F.col("_g_im").alias("im"))
    bins = _with_kernel(samples.select(*at).distinct(), kernel)
    bins = bins.withColumns({"gu": F.col("iu") + F.col("du"), "gv": F.col("iv") + F.col("dv")})
    v = Cx.of("wt_re", "wt_im") * Cx.of("re", "im").conj()
    values = bins.join(grid.select(*keys, "gu", "gv", "re", "im"), [*keys, "gu", "gv"]).groupBy(*at).agg(F.sum(v.re).alias("re"), F.sum(v.im).alias("im"))
    return samples.select(*row, *[c for c in at if c not in row]).join(values, at).select(*row, "re", "im")


#: Pixels of a direct image, at most; phases that NumPy works out at once.
PIXELS, PHASES = 1 << 20, 1 << 20


def direct_image(samples: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The direct sum over samples (u, v in wavelengths, re, im) for a list of pixels (x, y, l, m), divided by their number.

    The pixel list goes to the tasks, so it must not have more than PIXELS rows.
    A batch of samples leaves one row a pixel and key.
    """
    px = pixels.select("x", "y", "l", "m").limit(PIXELS + 1).collect()
    if len(px) > PIXELS:
        raise ValueError("too many pixels for a direct image: grid and transform instead")
    x, y = (pa.array([r[i] for r in px], pa.int32()) for i in (0, 1))
    lm = np.array([(r[2], r[3]) for r in px], float).reshape(-1, 2)
    n_keys, types = len(keys), dict(samples.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["x int, y int, s double, n long"])

    def run(it):
        for b in it:
            code = np.zeros(b.num_rows, np.int64)
            for i in range(n_keys):
                d = b.column(i).dictionary_encode(null_encoding="encode")
                code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
            uv, re, im = np.stack([b.column(n_keys + i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1), *(b.column(n_keys + i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for c in np.unique(code):
                rows, total = np.flatnonzero(code == c), np.zeros(len(lm))
                for lo in range(0, len(rows), max(1, PHASES // max(1, len(lm)))):
                    r = rows[lo : lo + max(1, PHASES // max(1, len(lm)))]
                    phase = 2 * math.pi * (uv[r] @ lm.T)
                    total += re[r] @ np.cos(phase) + im[r] @ np.sin(phase)
                of = pa.array(np.full(len(lm), rows[0]))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(n_keys)), x, y, pa.array(total), pa.array(np.full(len(lm), len(rows)))], [*keys, "x", "y", "s", "n"])

    s = samples.where("u IS NOT NULL AND v IS NOT NULL AND re IS NOT NULL AND im IS NOT NULL").select(*keys, *[F.col(c).cast("double").alias(c) for c in ("u", "v", "re", "im")])
    return s.mapInArrow(run, schema).groupBy(*keys, "x", "y").agg((F.sum("s") / F.sum("n")).alias("value"))


def dense(pdf, n: int, gu: str = "gu", gv: str = "gv", re: str = "re", im: str = "im") -> np.ndarray:
    grid = np.zeros((n, n), complex)
    inside = (pdf[gu] >= 0) & (pdf[gu] < n) & (pdf[gv] >= 0) & (pdf[gv] < n)
    p = pdf[inside]
    np.add.at(grid, (p[gu].to_numpy(), p[gv].to_numpy()), p[re].to_numpy() + 1j * p[im].to_numpy())
    return grid


def images_of(grid: DataFrame, keys: list[str], n: int, planes: dict[str, tuple[str, str]] | None = None, correct: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """Transforms each key's cells to n x n images, scaled by n*n, origin in the middle: one bounded plane per task.

    planes names the images and the columns of their cells, {"value": ("re", "im")} by default.
    """
    planes = planes or {"value": ("re", "im")}
    schema = ", ".join(f"{k} {dict(grid.dtypes)[k]}" for k in keys) + ", x int, y int, " + ", ".join(f"{p} double" for p in planes)

    def run(key, pdf):
        import pandas as pd

        x, y = np.indices((n, n))
        out = {**dict(zip(keys, ([k] * n * n for k in key), strict=True)), "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32")}
        for name, (re, im) in planes.items():
            image = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(dense(pdf, n, re=re, im=im)))).real * n * n
            out[name] = tapered(image, correct).ravel()
        return pd.DataFrame(out)

    return grid.groupBy(*keys).applyInPandas(run, schema)


def tapered(image: np.ndarray, correct: Callable[[int], np.ndarray] | None) -> np.ndarray:
    """The image divided by the transform of the gridding kernel, 0 where that is 0."""
    if correct is None:
        return image
    c = np.outer(correct(len(image)), correct(len(image)))
    return np.where(c > 1e-12, image / np.maximum(c, 1e-12), 0.0)


def grid_of(image: np.ndarray, correct: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
    """The grid that a model image is degridded from: divided by the kernel's transform, then transformed.

    It is the inverse of the transform of images_of, up to the factor n*n.
    """
    return np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(tapered(image, correct))))


def grids_of(images: DataFrame, keys: list[str], n: int, value: str = "value", correct: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """Cells (keys, gu, gv, re, im) of model images (keys, x, y, value); an empty model gives no cells."""
    schema = ", ".join(f"{k} {dict(images.dtypes)[k]}" for k in keys) + ", gu int, gv int, re double, im double"

    def run(key, pdf):
        import pandas as pd

        image = np.zeros((n, n))
        image[pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf[value].to_numpy()
        if not image.any():
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        z = grid_of(image, correct)
        u, v = np.indices((n, n))
        return pd.DataFrame({**dict(zip(keys, ([k] * n * n for k in key), strict=True)), "gu": u.ravel().astype("int32"), "gv": v.ravel().astype("int32"), "re": z.real.ravel(), "im": z.imag.ravel()})

    return images.groupBy(*keys).applyInPandas(run, schema)


def spheroidal_correction(n: int) -> np.ndarray:
    return np.array([spheroidal_value(abs(i - n // 2) / (n // 2)) for i in range(n)])
