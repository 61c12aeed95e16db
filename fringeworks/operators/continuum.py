"""Continuum of spectra as a polynomial and harmonics together, fitted robustly in blocks of channels.

A spectrum is bounded by its channels; spectra of a partition are fitted one by
one where the grouping has put them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def basis(x: np.ndarray, order: int, harmonics: int) -> np.ndarray:
    """Columns over x in [0, 1): powers up to order, sine and cosine of half turns, once to harmonics times."""
    turns = np.pi * np.outer(x, np.arange(1, harmonics + 1))
    return np.concatenate([np.vander(x, order + 1, increasing=True), np.sin(turns), np.cos(turns)], axis=1)


def affordable(order: int, harmonics: int, valid: int, width: int) -> tuple[int, int]:
    """Terms that so many valid channels of a block bear: five channels a term, and one less of the larger kind where under 60 % are valid."""
    fewer = valid < 0.6 * width
    while (order > 0 or harmonics > 0) and (fewer or valid < 5 * (order + 1 + 2 * harmonics)):
        order, harmonics = (order - 1, harmonics) if order > harmonics else (order, harmonics - 1)
        fewer = False
    return order, harmonics


def model(y: np.ndarray, good: np.ndarray, order: int, harmonics: int, threshold: float = 0.0, rounds: int = 3) -> np.ndarray:
    """The continuum of one block (not a number where nothing is good).

    With a threshold, channels whose residual is further from the median than so
    many robust deviations ((q75 - q25) / 1.35) leave the fit, round by round.
    """
    n = len(y)
    x, out, use = np.arange(n) / n, np.zeros(n), good
    for i in range(rounds if threshold > 0 else 1):
        if threshold > 0:
            rest = y - out
            q25, q50, q75 = np.quantile(rest[good], [0.25, 0.5, 0.75]) if good.any() else (0, 0, 0)
            now = good & (np.abs(rest - q50) <= threshold * (q75 - q25) / 1.35)
            if i and (now == use).all():
                break
            use = now if now.any() else good
        if not use.any():
            return np.full(n, np.nan)
        a = basis(x, *affordable(order, harmonics, int(use.sum()), n))
        out = a @ np.linalg.lstsq(a[use], y[use], rcond=1e-10)[0]
    return out


def subtracted(spectra: DataFrame, by: list[str], channels: int, order: int, harmonics: int, values: tuple[str, ...] = ("re", "im"), width: int = 0, offset: int = 0, threshold: float = 0.0) -> DataFrame:
    """by, chan, values less their continuum, of spectra (by, chan, values, flag).

    Blocks of width channels (0: all) begin at -offset. Flagged and missing
    channels take no part in fits; flagged ones are given their residual too.
    """
    import pandas as pd

    types = dict(spectra.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["chan int"] + [f"{v} double" for v in values])

    def run(key, pdf):
        chan = pdf["chan"].to_numpy()
        out = {**{b: [k] * len(pdf) for b, k in zip(by, key, strict=True)}, "chan": chan.astype("int32")}
        for v in values:
            y, good = np.zeros(channels), np.zeros(channels, bool)
            y[chan], good[chan] = pdf[v].fillna(0).to_numpy(), ~pdf["flag"].to_numpy() & np.isfinite(pdf[v].to_numpy(float))
            fit = np.zeros(channels)
            for at in range(-offset, channels, width or channels):
                part = slice(max(0, at), min(channels, at + (width or channels)))
                if part.stop > part.start:
                    fit[part] = model(y[part], good[part], order, harmonics, threshold)
            out[v] = pdf[v].to_numpy(float) - fit[chan]
        return pd.DataFrame(out)

    return spectra.where(f"chan >= 0 AND chan < {channels}").groupBy(*by).applyInPandas(run, schema)
