"""Dense image operators: regridding, oversampling, snapshots, spectra of pixels, beam-forming weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cubic(t: np.ndarray) -> np.ndarray:
    """The interpolating cubic that is right up to squares."""
    t = np.abs(t)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


def _lanczos(t: np.ndarray, lobes: int = 3) -> np.ndarray:
    return np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)


#: Method -> (kernel over distance in pixels, pixels that it reaches to either side).
INTERPOLATION = {"cubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


def regrid(image: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = "linear") -> np.ndarray:
    """Values at fractional pixel places by nearest, linear, cubic or lanczos interpolation; 0 outside, and beyond the edge for what reaches there."""
    n, m = image.shape
    if method in INTERPOLATION:
        kernel, reach = INTERPOLATION[method]
        i, j = np.floor(x).astype(int), np.floor(y).astype(int)
        steps = range(1 - reach, reach + 1)
        wx, wy = ([kernel(p - (q + s)) for s in steps] for p, q in ((x, i), (y, j)))
        wx, wy = ([w / sum(ws) for w in ws] for ws in (wx, wy))
        out = np.zeros(np.shape(x))
        for a, u in zip(steps, wx, strict=True):
            for b, v in zip(steps, wy, strict=True):
                ok = (i + a >= 0) & (i + a < n) & (j + b >= 0) & (j + b < m)
                out += np.where(ok, u * v * image[np.clip(i + a, 0, n - 1), np.clip(j + b, 0, m - 1)], 0.0)
        return out
    if method == "nearest":
        i, j = np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int)
        ok = (i >= 0) & (i < n) & (j >= 0) & (j < m)
        return np.where(ok, image[np.clip(i, 0, n - 1), np.clip(j, 0, m - 1)], 0.0)
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(np.shape(x))
    for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1)):
        w = np.where(di, x - i, 1 - (x - i)) * np.where(dj, y - j, 1 - (y - j))
        ok = (i + di >= 0) & (i + di < n) & (j + dj >= 0) & (j + dj < m)
        out += np.where(ok, w * image[np.clip(i + di, 0, n - 1), np.clip(j + dj, 0, m - 1)], 0.0)
    return out


def oversampled(image: np.ndarray, factor: int) -> np.ndarray:
    """Finer pixels by zero-padding the transform; the values at the old pixels stay."""
    n = len(image)
    big = np.zeros((n * factor, n * factor), complex)
    at = (n * factor - n) // 2
    big[at : at + n, at : at + n] = np.fft.fftshift(np.fft.fft2(image))
    return np.fft.ifft2(np.fft.ifftshift(big)).real * factor * factor


def radially_smeared(image: np.ndarray, scales: int = 21, width: float = 0.005) -> np.ndarray:
    """The image whose transform is the mean of the image's own over a band of radial scales.

    A band of relative width seen as one channel: V(u) becomes the mean of
    V(s u), s by the midpoint rule over 1 - width / 2 to 1 + width / 2. V at
    scaled frequencies is the sum over pixels itself, as a matrix an axis, so
    nothing is interpolated; a source at x is spread over s x from the centre.
    """
    def frequencies(size: int) -> np.ndarray:
        return np.fft.fftshift(np.fft.fftfreq(size))

    def phases(size: int, s: float) -> np.ndarray:
        return np.exp(-2j * np.pi * s * np.outer(frequencies(size), np.arange(size) - size // 2))

    n, m = image.shape
    band = 1 + width * ((np.arange(scales) + 0.5) / scales - 0.5)
    mean = sum(phases(n, s) @ image @ phases(m, s).T for s in band) / scales
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(mean))).real


def regridded(pixels: DataFrame, by: list[str], shift_x: str, shift_y: str, values: list[str]) -> DataFrame:
    """Images (by, x, y, values) moved by fractions of pixels, linear between neighbours: each pixel goes to the four around its new place, which is one grouped sum."""
    fx, fy = F.col(shift_x) - F.floor(shift_x), F.col(shift_y) - F.floor(shift_y)
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("c")) for i in (0, 1) for j in (0, 1)])
    out = pixels.select(*by, (F.col("x") + F.floor(shift_x)).alias("_x"), (F.col("y") + F.floor(shift_y)).alias("_y"), *values, F.explode(four).alias("_f")).where("_f.c > 0")
    return out.groupBy(*by, (F.col("_x") + F.col("_f.i")).cast("int").alias("x"), (F.col("_y") + F.col("_f.j")).cast("int").alias("y")).agg(*[F.sum(F.col(v) * F.col("_f.c")).alias(v) for v in values])


def extracted_spectra(vis: DataFrame, by: list[str], n_chan: int, padding: int = 1, transform: bool = False) -> DataFrame:
    """by, place, re, im: mean spectra with flagged channels as 0, padded on both sides, or their transforms to lags.

    A spectrum is bounded by n_chan; a block of them goes to NumPy at once.
    """
    good = ~F.col("flag")
    cells = vis.groupBy(*by, "chan").agg(F.coalesce(F.avg(F.when(good, F.col("re"))), F.lit(0.0)).alias("re"), F.coalesce(F.avg(F.when(good, F.col("im"))), F.lit(0.0)).alias("im"))
    rows = cells.groupBy(*by).agg(F.collect_list("chan").alias("c"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))
    n = n_chan * padding
    types = dict(vis.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["at array<struct<place: int, re: double, im: double>>"])

    def run(it):
        for pdf in it:
            z = np.zeros((len(pdf), n), complex)
            for k, (c, re, im) in enumerate(zip(pdf["c"], pdf["re"], pdf["im"], strict=True)):
                z[k, np.asarray(c) + (n - n_chan) // 2] = np.asarray(re) + 1j * np.asarray(im)
            if transform:
                z = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(z, axes=1), axis=1), axes=1)
            yield pdf[by].assign(at=[[{"place": i, "re": v.real, "im": v.imag} for i, v in enumerate(row)] for row in z])

    return rows.mapInPandas(run, schema).select(*by, F.inline("at"))


def sensitivity_loss(before: np.ndarray, after: np.ndarray) -> float:
    """Loss of sensitivity when a filter turns one PSF into another: from the amplitudes of their transforms."""
    w, v = np.abs(np.fft.fft2(before)), np.abs(np.fft.fft2(after))
    return float(math.sqrt((v * v).sum() / (w * w).sum()) * w.sum() / v.sum())


def snapshot_segments(samples: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Segments of integrations that share one w = a u + b v plane: a new one starts when the residual of the last fit is beyond the tolerance.

    The rule is recursive, so each dataset is one ordered pass; its input is one
    row of sums per integration, not the samples.
    """
    import pandas as pd

    s = samples.groupBy(*by, "time_s").agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("uu", "u*u"), ("uv", "u*v"), ("vv", "v*v"), ("uw", "u*w"), ("vw", "v*w"), ("ww", "w*w"))], F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{b} {dict(samples.dtypes)[b]}" for b in by) + ", time_s double, segment int, a double, b double"

    def run(key, pdf):
        pdf = pdf.sort_values("time_s")
        out, segment, fit = [], -1, None
        for t in pdf.itertuples():
            rms = lambda a, b, t=t: math.sqrt(max(0.0, (t.ww + a * a * t.uu + b * b * t.vv + 2 * a * b * t.uv - 2 * a * t.uw - 2 * b * t.vw) / t.n))
            if fit is None or rms(*fit) > tolerance:
                fit = tuple(np.linalg.lstsq(np.array([[t.uu, t.uv], [t.uv, t.vv]]), np.array([t.uw, t.vw]), rcond=None)[0])
                segment += 1
            out.append((*key, t.time_s, segment, float(fit[0]), float(fit[1])))
        return pd.DataFrame(out, columns=[*by, "time_s", "segment", "a", "b"])

    return s.groupBy(*by).applyInPandas(run, schema)


#: Cells of spectra that image_continuum_subtracted gives out at once, or one longer spectrum.
CELLS = 1 << 16


def shifted_blocks(n: int, block: int, interleave: bool = False, shift: Sequence[int] = ()) -> list[tuple[int, int, int, int]]:
    """(first, end) of the channels that a block's fit sees, and of those that it is taken from; the latter cover 0..n once.

    Blocks are steps of the observed spectrum: in a cube whose channels lie
    shift[chan] beyond it, their borders move along. Interleaved blocks overlap
    by halves and serve their middle. The last shift holds for channels after it.
    """
    block = block or n
    step = max(1, block // 2) if interleave and block < n else block
    moved = lambda c: min(n, max(0, c + (shift[min(c, len(shift) - 1)] if len(shift) else 0))) if 0 < c < n else c
    out, done = [], 0
    for a in range(0, n, step):
        first, end = moved(a), moved(min(n, a + block))
        last = a + step >= n
        serve = n if last else max(done, min(n, moved(a + step) + (step // 2 if step < block else 0)))
        if serve > done:
            out.append((min(first, done), n if last else max(end, serve), done, serve))
        done = max(done, serve)
    return out


def image_continuum_subtracted(pixels: DataFrame, order: int, threshold: float = 2.0, block: int = 0, interleave: bool = False, shift: Sequence[int] = ()) -> DataFrame:
    """Polynomial continuum taken out of every pixel's spectrum (x, y, chan, value), over blocks of channels.

    Fit points lie within threshold * 2 * (q50 - q15) / 1.35 of the median of
    what a line through the trimmed spectrum leaves; the line takes every k-th
    channel of long spectra. shift, one number a channel, moves the blocks of a
    cube in another frame (frames.channel_shift). Spectra stay Arrow arrays, and
    some CELLS cells at a time are told: Python holds a batch and one spectrum.
    """
    import pyarrow as pa

    def left(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        good = np.isfinite(v)
        if good.sum() <= order + 1:
            return v
        few = np.zeros(len(v), bool)
        few[:: max(1, min(10, len(v) // 100))] = True
        few = few & good if (few & good).sum() > 2 else good
        low, high = np.quantile(v[few], [0.05, 0.95])
        trim = few & (v >= low) & (v <= high)
        line = v - np.polyval(np.polyfit(x[trim], v[trim], 1), x) if trim.sum() > 2 else v
        q15, q50 = np.quantile(line[good], [0.15, 0.5])
        use = good & (np.abs(line - q50) <= max(threshold * 2 * (q50 - q15) / 1.35, 1e-12))
        return v - np.polyval(np.polyfit(x[use], v[use], order), x) if use.sum() > order else v

    blocks: dict[int, list[tuple[int, int, int, int]]] = {}

    def fitted(t: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = y.copy()
        if len(t) not in blocks:
            blocks.clear()
            blocks[len(t)] = shifted_blocks(len(t), block, interleave, shift)
        for first, end, a, z in blocks[len(t)]:
            out[a:z] = left(t[first:end] - t[first], y[first:end])[a - first : z - first]
        return out

    def told(b: pa.RecordBatch, rows: list[int], chans: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        of = pa.array(np.repeat(rows, [len(c) for c in chans]))
        return pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(chans)), pa.array(np.concatenate(values), from_pandas=True)], ["x", "y", "chan", "value"])

    def run(it):
        for b in it:
            ends, cells = b.column(2).offsets.to_numpy(), b.column(2).values
            rows, chans, values, held = [], [], [], 0
            for i in range(b.num_rows):
                own = cells.slice(ends[i], ends[i + 1] - ends[i])
                chan, value = (own.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                rows.append(i)
                chans.append(chan.astype("int32"))
                values.append(fitted(chan.astype(float), value.astype(float)))
                held += len(chan)
                if held >= CELLS or i == b.num_rows - 1:
                    yield told(b, rows, chans, values)
                    rows, chans, values, held = [], [], [], 0

    cells = pixels.select("x", "y", F.col("chan").cast("int").alias("chan"), F.col("value").cast("double").alias("value")).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("chan", "value"))).alias("cells"))
    return cells.mapInArrow(run, "x int, y int, chan int, value double")


def beamforming_weights(samples: DataFrame, by: list[str], n: int) -> DataFrame:
    """Leading eigenvector of each group's covariance (antenna1, antenna2, re, im): sums in SQL, a small eigenproblem per group."""
    import pandas as pd

    from .calibrate import eigen_weights

    c = samples.groupBy(*by, "antenna1", "antenna2").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    schema = ", ".join(f"{b} {dict(samples.dtypes)[b]}" for b in by) + ", antenna int, w_re double, w_im double"

    def run(key, pdf):
        m = np.zeros((n, n), complex)
        m[pdf["antenna1"], pdf["antenna2"]] = pdf["re"] + 1j * pdf["im"]
        w = eigen_weights(m)
        return pd.DataFrame({**{b: [v] * n for b, v in zip(by, key, strict=True)}, "antenna": np.arange(n, dtype="int32"), "w_re": w.real, "w_im": w.imag})

    return c.groupBy(*by).applyInPandas(run, schema)
