"""Applying and solving calibration: joins and sums in SQL, small dense solves per independent key."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.complexcols import Cx
from ..functions.scalar import C_LIGHT
from . import ordered as O  # noqa: E741


def corrected(value: Cx, g1: Cx, g2: Cx) -> Cx:
    """value / (g1 conj(g2))."""
    return value / (g1 * g2.conj())


def corrupted(value: Cx, g1: Cx, g2: Cx) -> Cx:
    return value * g1 * g2.conj()


def interpolated(before: Cx, after: Cx, t: Column, tb: Column, ta: Column) -> Cx:
    """Amplitude ratio linear in time, phase along the shorter arc."""
    f = (t - tb) / (ta - tb)
    g = after / before
    step = Cx.polar(1 + (g.abs() - 1) * f, g.arg() * f)
    mixed = before * step
    both = (before.abs2() > 0) & (after.abs2() > 0) & (ta > tb)
    return Cx(F.when(both, mixed.re).otherwise(before.re), F.when(both, mixed.im).otherwise(before.im))


def phase_referenced(gains: DataFrame, reference: int, by: list[str]) -> DataFrame:
    """Every gain turned by the phase of the reference antenna's in the same group; groups without it stay."""
    ref = gains.where(F.col("antenna") == reference).select(*by, F.col("g_re").alias("_rr"), F.col("g_im").alias("_ri"))
    j = gains.join(ref, by, "left")
    r = Cx.of("_rr", "_ri").conj()
    turned = Cx.of("g_re", "g_im") * r / r.abs()
    return j.select(*by, "antenna", F.coalesce(turned.re, F.col("g_re")).alias("g_re"), F.coalesce(turned.im, F.col("g_im")).alias("g_im"))


def preaveraged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per baseline and pair of polarisations (pol of the model conjugated, pol2 of the partner): sums of w conj(model) measured and w conj(model) model.

    rows: row_id, pol, re, im, m_re, m_im, weight, flag. Polarisations of one
    row meet by arrays, so no self-join is needed.
    """
    good = rows.where("NOT flag")
    cells = good.groupBy("row_id", *by).agg(F.collect_list(F.struct("pol", "re", "im", "m_re", "m_im", "weight")).alias("p"))
    pairs = cells.select(*by, F.explode("p").alias("a"), "p").select(*by, "a", F.explode("p").alias("b"))
    model = Cx.of("a.m_re", "a.m_im").conj() * F.col("a.weight")
    measured, partner = model * Cx.of("b.re", "b.im"), model * Cx.of("b.m_re", "b.m_im")
    return pairs.groupBy(*by, F.col("a.pol").alias("pol"), F.col("b.pol").alias("pol2")).agg(F.sum(measured.re).alias("vm_re"), F.sum(measured.im).alias("vm_im"), F.sum(partner.re).alias("mm_re"), F.sum(partner.im).alias("mm_im"))


def solve_gains(products: np.ndarray, power: np.ndarray, iterations: int = 200) -> np.ndarray:
    """Antenna gains g with products[i, j] ~ power[i, j] g_i conj(g_j): alternating least squares, phases to the first antenna."""
    n = len(products)
    g = np.ones(n, complex)
    for i in range(iterations):
        top = (products * g[None]).sum(1)
        low = (power * np.abs(g[None]) ** 2).sum(1)
        new = np.where(low > 0, top / np.where(low > 0, low, 1), g)
        g = new if i % 2 and i > iterations // 2 else (g + new) / 2
    live = np.flatnonzero(power.sum(1) > 0)
    if len(live) and abs(g[live[0]]) > 0:
        g = g * np.conj(g[live[0]]) / abs(g[live[0]])
    return np.where(power.sum(1) > 0, g, 1.0)


def solved_gains(products: DataFrame, by: list[str], n_antennas: int, least: float = 0.0) -> DataFrame:
    """Gains per (by, antenna) from baseline products (antenna1, antenna2, vm_re, vm_im, mm_re): independent keys side by side; amplitudes under least are not valid."""
    import pandas as pd

    schema = ", ".join(f"{b} {dict(products.dtypes)[b]}" for b in by) + (", " if by else "") + "antenna int, g_re double, g_im double, valid boolean"

    def run(key, pdf):
        v, p = np.zeros((n_antennas, n_antennas), complex), np.zeros((n_antennas, n_antennas))
        a, b = pdf["antenna1"].to_numpy(), pdf["antenna2"].to_numpy()
        x = pdf["vm_re"].to_numpy() + 1j * pdf["vm_im"].to_numpy()
        np.add.at(v, (a, b), x)
        np.add.at(v, (b, a), x.conj())
        np.add.at(p, (a, b), pdf["mm_re"].to_numpy())
        np.add.at(p, (b, a), pdf["mm_re"].to_numpy())
        np.fill_diagonal(v, 0)
        np.fill_diagonal(p, 0)
        g = solve_gains(v, p)
        return pd.DataFrame({**{k: [x] * n_antennas for k, x in zip(by, key, strict=True)}, "antenna": np.arange(n_antennas, dtype="int32"), "g_re": g.real, "g_im": g.imag, "valid": (p.sum(1) > 0) & (np.abs(g) >= least)})

    return products.groupBy(*by).applyInPandas(run, schema)


def solved_delays(spectra: DataFrame, by: list[str], channel_width: float) -> DataFrame:
    """Delay (s) of each averaged spectrum (by, chan, re, im): phase slope by weighted least squares of unwrapped phases."""
    import pandas as pd

    schema = ", ".join(f"{b} {dict(spectra.dtypes)[b]}" for b in by) + ", delay double, n_chan long"

    def run(key, pdf):
        pdf = pdf.sort_values("chan")
        z = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        good = np.abs(z) > 0
        chan, phase = pdf["chan"].to_numpy()[good] * channel_width, np.unwrap(np.angle(z[good]))
        slope = float(np.polyfit(chan, phase, 1)[0]) / (2 * math.pi) if good.sum() > 1 else 0.0
        return pd.DataFrame({**{k: [x] for k, x in zip(by, key, strict=True)}, "delay": [slope], "n_chan": [int(good.sum())]})

    return spectra.groupBy(*by).applyInPandas(run, schema)


def antenna_delays(baselines: list[tuple[int, int, float]], reference: int) -> dict[int, float]:
    """Per-antenna delays from baseline delays, the reference's being 0."""
    antennas = sorted({a for a, _, _ in baselines} | {b for _, b, _ in baselines} | {reference})
    at = {a: i for i, a in enumerate(antennas)}
    m = np.zeros((len(baselines) + 1, len(antennas)))
    y = np.zeros(len(baselines) + 1)
    for k, (a, b, d) in enumerate(baselines):
        m[k, at[a]] += 1
        m[k, at[b]] -= 1
        y[k] = d
    m[-1, at[reference]] = 1
    x = np.linalg.lstsq(m, y, rcond=None)[0]
    return {a: float(x[i]) for a, i in at.items()}


def _turns(step: Column) -> Column:
    """Whole turns by which a step of phase is beyond half a turn either way."""
    return F.when(step > 0, F.ceil((step - math.pi) / (2 * math.pi))).otherwise(F.floor((step + math.pi) / (2 * math.pi)))


def _unwrapped_by_hour_angle(phases: DataFrame, by: list[str], bins: int) -> DataFrame:
    """phase without its turns along ha: counted inside narrow bins of ha, then over the bins of a key, so that no key is one task's."""
    rows = phases.withColumn("_bin", F.floor(F.col("ha") * (bins / (2 * math.pi))))
    inside = Window.partitionBy(*by, "_bin").orderBy("ha", "dec", "phase")
    rows = rows.withColumn("_step", F.coalesce(_turns(F.col("phase") - F.lag("phase").over(inside)), F.lit(0)))
    rows = rows.withColumn("_turn", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("ha", "dec", "phase")
    ends = rows.groupBy(*by, "_bin").agg(F.min(place)["phase"].alias("_first"), F.max(place)["phase"].alias("_last"), F.sum("_step").alias("_all"))
    along = Window.partitionBy(*by).orderBy("_bin")
    ends = ends.withColumn("_cross", F.coalesce(_turns(F.col("_first") - F.lag("_last").over(along)) + F.lag("_all").over(along), F.lit(0)))
    ends = ends.select(*by, "_bin", F.sum("_cross").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"))
    return rows.join(ends, [*by, "_bin"]).withColumn("phase", F.col("phase") - 2 * math.pi * (F.col("_turn") + F.col("_before")))


def baseline_offsets(phases: DataFrame, by: list[str], freq: float, bins: int = 4096) -> DataFrame:
    """Position errors (m) of antennas from phases (by, ha, dec, phase): grouped normal-equation sums of a 4-parameter linear fit, solved per antenna."""
    schema = ", ".join(f"{b} {dict(phases.dtypes)[b]}" for b in by) + ", dx double, dy double, dz double, offset double"
    k = 2 * math.pi * freq / C_LIGHT
    ha, dec = F.col("ha"), F.col("dec")
    rows = _unwrapped_by_hour_angle(phases, by, bins).select(*by, "phase", (k * F.cos(dec) * F.cos(ha)).alias("_a0"), (-k * F.cos(dec) * F.sin(ha)).alias("_a1"), (k * F.sin(dec)).alias("_a2"), F.lit(1.0).alias("_a3"))
    a = [f"_a{i}" for i in range(4)]
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(F.col(p) * F.col(q)) for p in a for q in a]).alias("_n"), F.array(*[F.sum(F.col(p) * F.col("phase")) for p in a]).alias("_y"))

    def run(it):
        for pdf in it:
            x = [np.linalg.lstsq(np.array(list(n)).reshape(4, 4), np.array(list(y)), rcond=1e-12)[0] for n, y in zip(pdf["_n"], pdf["_y"], strict=True)]
            yield pdf[by].assign(**{c: [v[i] for v in x] for i, c in enumerate(("dx", "dy", "dz", "offset"))})

    return sums.mapInPandas(run, schema)


def pointing_offsets(scans: DataFrame, by: list[str], fwhm: float) -> DataFrame:
    """Pointing errors from amplitudes at several offsets (by, dx, dy, amp): Gauss-Newton on a round beam of known width."""
    import pandas as pd

    schema = ", ".join(f"{b} {dict(scans.dtypes)[b]}" for b in by) + ", off_x double, off_y double, peak double"
    k = 4 * math.log(2) / fwhm**2

    def run(key, pdf):
        x, y, a = (pdf[c].to_numpy(float) for c in ("dx", "dy", "amp"))
        p = np.array([0.0, 0.0, a.max()])
        for _ in range(10):
            e = np.exp(-k * ((x - p[0]) ** 2 + (y - p[1]) ** 2))
            j = np.stack([p[2] * e * 2 * k * (x - p[0]), p[2] * e * 2 * k * (y - p[1]), e], 1)
            p = p + np.linalg.lstsq(j, a - p[2] * e, rcond=None)[0]
        return pd.DataFrame({**{b: [v] for b, v in zip(by, key, strict=True)}, "off_x": [p[0]], "off_y": [p[1]], "peak": [p[2]]})

    return scans.groupBy(*by).applyInPandas(run, schema)


def continuum_fit(spectra: DataFrame, by: list[str], order: int, x: str = "chan", value: str = "re", rounds: int = 3, clip: float = 3.0) -> DataFrame:
    """Residuals of a robust polynomial fit per spectrum; points beyond clip * (q75 - q25) / 1.35 of the median residual leave the fit."""
    import pandas as pd

    schema = ", ".join(f"{b} {dict(spectra.dtypes)[b]}" for b in by) + f", {x} int, residual double"

    def run(key, pdf):
        t, y = pdf[x].to_numpy(float), pdf[value].to_numpy(float)
        use = np.isfinite(y)
        res = y
        for _ in range(rounds):
            if use.sum() <= order:
                break
            res = y - np.polyval(np.polyfit(t[use], y[use], order), t)
            q25, q50, q75 = np.quantile(res[use], [0.25, 0.5, 0.75])
            use = np.isfinite(y) & (np.abs(res - q50) <= max(clip * (q75 - q25) / 1.35, 1e-12))
        return pd.DataFrame({**{b: [v] * len(t) for b, v in zip(by, key, strict=True)}, x: t.astype("int32"), "residual": res})

    return spectra.groupBy(*by).applyInPandas(run, schema)


def unwrapped(rows: DataFrame, by: list[str], order: list[str], phase: str, bucket: Column) -> DataFrame:
    """Adds unwrapped and step (from the row before): steps beyond 3 pi / 2 gain or lose a turn, summed over the order, bucket by bucket."""
    seen = O.previous(rows, by, order, bucket, [phase])
    step = F.col(phase) - F.col(f"_prev.{phase}")
    turn = F.when(step > 1.5 * math.pi, -2 * math.pi).when(step < -1.5 * math.pi, 2 * math.pi).otherwise(0.0)
    seen = O.running_sum(seen.withColumn("_turn", F.coalesce(turn, F.lit(0.0))), by, order, bucket, F.col("_turn"), "_turns")
    return seen.withColumns({"unwrapped": F.col(phase) + F.col("_turns"), "step": step + F.col("_turn")}).drop("_prev", "_turn", "_turns")


def eigen_weights(covariance: np.ndarray) -> np.ndarray:
    """Beam-forming weights: the eigenvector of the largest eigenvalue of a Hermitian matrix, first component real and positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.conj().T) / 2)
    v = vectors[:, int(values.argmax())]
    lead = v[int(np.abs(v).argmax())]
    return v * np.conj(lead) / abs(lead)
