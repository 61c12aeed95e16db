"""Antenna delays: lags of averaged spectra by transform, refined by phase slopes, then one joint fit of all baselines.

A baseline's spectrum is bounded by its channels; a block of them goes to NumPy
at once. The joint fit's normal equations are grouped sums, solved per key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.complexcols import Cx


def spectra(vis: DataFrame, by: list[str], average: int = 1, cutoff: float | None = None) -> DataFrame:
    """by, antenna1, antenna2, chan, re, im, n: mean unflagged samples of every baseline, average channels as one; amplitudes from cutoff on left out."""
    good = vis.where("NOT flag AND antenna1 <> antenna2")
    if cutoff is not None:
        good = good.where(Cx.of("re", "im").abs() < cutoff)
    chan = F.floor(F.col("chan") / average).cast("int")
    return good.groupBy(*by, "antenna1", "antenna2", chan.alias("chan")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.count(F.lit(1)).alias("n"))


def lag_peak(z: np.ndarray, width: float, padding: int = 8) -> tuple[float, float]:
    """(delay in seconds, share of the amplitudes that is in phase there) of a spectrum with 0 where it has nothing: the largest lag, between its neighbours by a parabola."""
    n = 1 << (padding * len(z) - 1).bit_length()
    lags = np.abs(np.fft.ifft(z.conj(), n)) * n
    k = int(lags.argmax())
    a, b, c = lags[k - 1], lags[k], lags[(k + 1) % n]
    bend = a - 2 * b + c
    at = k + (0.5 * (a - c) / bend if bend < 0 else 0.0)
    at -= n if at > n / 2 else 0
    return at / (n * width), float(b / max(np.abs(z).sum(), 1e-300))


def slope(z: np.ndarray, width: float) -> float:
    """Delay left in a spectrum whose phase turns by less than half a turn between channels that are there."""
    at = np.flatnonzero(np.abs(z) > 0)
    if len(at) < 2:
        return 0.0
    return float(np.polyfit(at * width, np.unwrap(np.angle(z[at])), 1, w=np.sqrt(np.abs(z[at])))[0]) / (2 * math.pi)


def baseline_delays(mean: DataFrame, by: list[str], channels: int, width: float, refine: bool = True) -> DataFrame:
    """by, antenna1, antenna2, delay, quality, n_chan of averaged spectra; baselines with fewer than two channels are left out."""
    rows = mean.groupBy(*by, "antenna1", "antenna2").agg(F.collect_list("chan").alias("c"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im")).where(F.size("c") > 1)
    types = dict(mean.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["antenna1 int, antenna2 int, delay double, quality double, n_chan int"])

    def run(it):
        for pdf in it:
            out = []
            for c, re, im in zip(pdf["c"], pdf["re"], pdf["im"], strict=True):
                z = np.zeros(channels, complex)
                z[np.asarray(c)] = np.asarray(re) + 1j * np.asarray(im)
                delay, quality = lag_peak(z, width)
                if refine:
                    delay += slope(z * np.exp(-2j * math.pi * width * delay * np.arange(channels)), width)
                out.append((delay, quality, len(c)))
            yield pdf[[*by, "antenna1", "antenna2"]].assign(delay=[o[0] for o in out], quality=[o[1] for o in out], n_chan=[o[2] for o in out]).astype({"antenna1": "int32", "antenna2": "int32", "n_chan": "int32"})

    return rows.mapInPandas(run, schema)


def antenna_delays(baselines: DataFrame, by: list[str], reference: int, least_quality: float = 0.0, excluded: list[tuple[int, int]] = ()) -> DataFrame:
    """by, antenna, delay, n_baselines: the least-squares delays of antennas, the reference's being 0, from delays first less second antenna weighed by quality.

    Excluded baselines and those under least_quality take no part. Antennas
    without a path to the reference have delays relative to each other, of mean 0.
    """
    import pandas as pd

    use = baselines.where(F.col("quality") >= least_quality)
    for a, b in excluded:
        use = use.where(~((F.col("antenna1") == a) & (F.col("antenna2") == b)))
    entry = lambda i, j, n, y: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), n.alias("n"), y.alias("y"), F.lit(1 if i == j else 0).alias("k"))
    w, wd, none = F.col("quality"), F.col("quality") * F.col("delay"), F.lit(0.0)
    four = F.array(entry("antenna1", "antenna1", w, wd), entry("antenna2", "antenna2", w, -wd), entry("antenna1", "antenna2", -w, none), entry("antenna2", "antenna1", -w, none))
    sums = use.select(*by, F.explode(four).alias("e")).groupBy(*by, "e.i", "e.j").agg(F.sum("e.n").alias("n"), F.sum("e.y").alias("y"), F.sum("e.k").alias("k"))
    types = dict(baselines.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["antenna int, delay double, n_baselines int"])

    def run(key, pdf):
        names = np.unique(np.append(pdf["i"], reference))
        i, j = np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])
        a, y, k = np.zeros((len(names), len(names))), np.zeros(len(names)), np.zeros(len(names), int)
        np.add.at(a, (i, j), pdf["n"])
        np.add.at(y, i, pdf["y"])
        np.add.at(k, i, pdf["k"])
        x = np.linalg.lstsq(a, y, rcond=1e-10)[0]
        linked = _linked(a, int(np.searchsorted(names, reference)))
        x = np.where(linked, x - x[np.searchsorted(names, reference)], x)
        return pd.DataFrame({**{b: [v] * len(names) for b, v in zip(by, key, strict=True)}, "antenna": names.astype("int32"), "delay": x, "n_baselines": k.astype("int32")})

    return sums.groupBy(*by).applyInPandas(run, schema)


def _linked(a: np.ndarray, start: int) -> np.ndarray:
    """Which antennas a path of baselines joins to the start."""
    seen = np.zeros(len(a), bool)
    seen[start] = True
    while True:
        more = seen | (np.abs(a[seen]) > 0).any(axis=0)
        if (more == seen).all():
            return seen
        seen = more
