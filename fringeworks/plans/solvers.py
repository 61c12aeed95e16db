"""Queries over solves of the samples themselves, noise and all. Tests hold them against dense solves of the same samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.scalar import rnd
from ..operators import apertures as AP
from ..operators import components as CO
from ..operators import continuum as CN
from ..operators import ddcal as DD
from ..operators import deconv as D
from ..operators import delays as Y
from ..operators import gridding as G
from ..operators import jones as Z
from ..operators import illumination as L_
from ..operators import lsqr as L
from ..operators import opcal as OP
from ..operators import select as P
from ..operators import snapshot as N
from ..operators import tapers as TP
from ..operators import taylor as T
from ..sources.driver_tables import ctes, table
from .imaging import _BOX, _planes, _samples
from .registry import query, r

ANTENNAS, CHANNELS, NOISE = 36, 16, 0.3


def band_gain(antenna, chan) -> Cx:
    """The bandpass that samples of lsqr queries went through: smooth over channels, unlike for each antenna."""
    return Cx.polar(1 + 0.1 * F.sin(antenna + chan / 6), 0.05 * (antenna % 7) + 0.01 * (antenna % 5) * chan)


def band_products(spark, sf):
    """Unflagged samples that went through the bandpass with the table's values as noise: sums per baseline and channel."""
    v = table(spark, sf, "vis").where("NOT flag AND sigma > 0 AND antenna1 <> antenna2")
    seen = band_gain(F.col("antenna1"), F.col("chan")) * band_gain(F.col("antenna2"), F.col("chan")).conj() + Cx.of("re", "im") * NOISE
    w = P.noise_weight("sigma")
    return v.groupBy("antenna1", "antenna2", "chan").agg(F.sum(seen.re * w).alias("vm_re"), F.sum(seen.im * w).alias("vm_im"), F.sum(w).alias("mm_re"))


@query("lsqr_bandpass")
def lsqr_bandpass(spark, sf):
    """Bandpass of all antennas and channels, each fitted for itself."""
    out = L.solved_bandpass(band_products(spark, sf), [], ANTENNAS, CHANNELS, L.Rules(damping=0.1, outer=5, inner=12, tolerance=1e-2))
    return out.withColumns({c: rnd(c, 4) for c in ("g_re", "g_im")})


@query("lsqr_bandpass_smooth")
def lsqr_bandpass_smooth(spark, sf):
    """The same with curvature over channels held down, more so from round to round."""
    out = L.solved_bandpass(band_products(spark, sf), [], ANTENNAS, CHANNELS, L.Rules(smoothing=30.0, least_smoothing=3.0, outer=4, inner=20, tolerance=1e-2))
    return out.withColumns({c: rnd(c, 4) for c in ("g_re", "g_im")})


#: Flux, l, m of the two directions.
DIRECTIONS = ((2.0, 0.001, -0.0004), (1.0, -0.0008, 0.0012))


def direction_gain(antenna, direction: int) -> Cx:
    return Cx.polar(1 + 0.05 * ((antenna + 3 * direction) % 5), 0.1 * ((antenna * (direction + 2)) % 6) - 0.2)


def direction_models() -> list[Cx]:
    return [S.point_source("freq", "u", "v", "w", flux, l, m, 0.0, 1.0) for flux, l, m in DIRECTIONS]  # noqa: E741


def seen_in_directions() -> Cx:
    """What samples are: the sum over directions of gain, conjugate gain and model, with the table's values as noise."""
    z = Cx.of("re", "im") * NOISE
    for d, model in enumerate(direction_models()):
        z = z + direction_gain(F.col("antenna1"), d) * direction_gain(F.col("antenna2"), d).conj() * model
    return z


@query("dd_gain_solve")
def dd_gain_solve(spark, sf):
    """Gains of all antennas towards two directions, per polarisation."""
    v = table(spark, sf, "vis").where("NOT flag AND sigma > 0")
    sums = DD.products(v, ["pol"], seen_in_directions(), direction_models(), P.noise_weight("sigma"))
    return DD.solved(sums, ["pol"], ANTENNAS, len(DIRECTIONS)).withColumns({c: rnd(c, 4) for c in ("g_re", "g_im")})


#: Wide channels, so that spectra show: reference frequency and width of a channel.
F0, WIDTH = 1.4e9, 4e7
#: x, y, flux and spectral index.
TAYLOR_SKY = ((20, 40, 2.0, -0.8), (45, 30, 1.0, 0.5), (33, 12, 0.5, -2.0))


def taylor_samples(spark, sf):
    """The table's samples, seeing sources with spectra; each falls into its cell whatever its frequency."""
    x = F.col("chan").cast("double") - CHANNELS / 2
    s = _samples(spark, sf).withColumn("freq", F0 + WIDTH * x)
    phase = lambda x, y: 2 * math.pi / 64 * ((F.col("iu") - 32) * (x - 32) + (F.col("iv") - 32) * (y - 32))
    flux = lambda f, a: f * F.pow(F.col("freq") / F0, F.lit(a))
    re, im = (sum(flux(f, a) * fn(phase(x, y)) for x, y, f, a in TAYLOR_SKY) for fn in (F.cos, F.sin))
    return s.select("pol", "plane", "fracu", "fracv", "iu", "iv", "sigma", "freq", re.alias("re"), im.alias("im"))


_X = f"(({F0!r} + {WIDTH!r} * (chan - {CHANNELS / 2!r})) / {F0!r} - 1)"
_BOXES = _BOX.replace("sum(wt) AS weight", "sum(wt) AS pcf, " + ", ".join([f"sum(re * wt * x ** {t}) AS r{t}_re, sum(-im * wt * x ** {t}) AS r{t}_im" for t in range(2)] + [f"sum(wt * x ** {t}) AS p{t}_re" for t in range(3)])).replace("SELECT *,", f"SELECT *, {_X} AS x,")


@query("taylor_equations", ctes("vis") + _BOXES + " SELECT pol, gu, gv, " + ", ".join(f"{r(c, 4)} AS {c}" for c in ("r0_re", "r0_im", "r1_re", "r1_im", "p0_re", "p1_re", "p2_re", "pcf")) + " FROM g")
def taylor_equations(spark, sf):
    """Residuals of two terms, three point-spread functions and the preconditioner function of every cell, from one pass."""
    s = _samples(spark, sf).withColumn("freq", F0 + WIDTH * (F.col("chan").cast("double") - CHANNELS / 2))
    e = T.equations(s, G.kernel_table(spark, G.box_kernel()), Cx.of("re", "im").conj(), T.offset("freq", F0), P.noise_weight("sigma"), ["pol"], 2)
    return e.select("pol", "gu", "gv", *[rnd(c, 4).alias(c) for c in ("r0_re", "r0_im", "r1_re", "r1_im", "p0_re", "p1_re", "p2_re", "pcf")])


def taylor_model(spark, sf, rounds: int = 3):
    control = lambda: D.Control(60, 0.3, fraction=0.1)
    return T.cycles(taylor_samples(spark, sf), G.kernel_table(spark, G.box_kernel()), 64, ["pol"], "freq", F0, P.noise_weight("sigma"), 2, rounds, control, stop=1e-4)


@query("taylor_cycles")
def taylor_cycles(spark, sf):
    """Pixels with flux, their flux and spectral index, after cycles of cleaning two terms on their own equations."""
    _, model = taylor_model(spark, sf)
    return T.spectral_index(model, 0.05).where("alpha IS NOT NULL").select("pol", "x", "y", rnd("model0", 3).alias("flux"), rnd("alpha", 2).alias("alpha"))


#: l, m of a source far from the middle of an image of one radian; wavelengths of a cell.
WIDE, CELL = (0.3125, -0.25), 1.0


def tilted_samples(spark, sf):
    """The table's samples in smaller units, on a plane that differs from scan to scan, seeing one source."""
    k = F.col("scan").cast("double")
    v = table(spark, sf, "vis", G.spread).where("NOT flag AND sigma > 0").withColumns({"u": F.col("u") / 50, "v": F.col("v") / 50, "time_s": k * 100})
    v = v.withColumn("w", 0.5 * F.sin(k) * F.col("u") + 0.5 * F.cos(k) * F.col("v"))
    l, m = WIDE  # noqa: E741
    phase = 2 * math.pi * (F.col("u") * l + F.col("v") * m + F.col("w") * (math.sqrt(1 - l * l - m * m) - 1))
    v = v.withColumns({"re": F.cos(phase), "im": F.sin(phase), "plane": F.lit(0)})
    v = N.segmented(v, ["pol"], 0.01, 400.0)
    rows = P.with_uv_cells(v, CELL, 4, 64, wavelengths=True)
    return rows.where(P.on_grid("iu", "iv", 2, 64, 64))


@query("snapshot_image")
def snapshot_image(spark, sf):
    """All scans imaged on their own planes, reprojected and added: the source is one pixel."""
    out = N.snapshot_image(tilted_samples(spark, sf), G.kernel_table(spark, G.spheroidal_kernel(2, 4)), ["pol"], 64, CELL, P.noise_weight("sigma"), correct=G.spheroidal_correction)
    return out.withColumns({c: rnd(c, 4) for c in ("value", "weight")})


def dish(wavelength: float):
    """A 12 m dish with a blocked middle whose taper follows the wavelength, in cells of a metre."""
    return L_.tapered(32, 1.0, 12.0, 2.0, edge_db=-10.0 * 0.25 / wavelength)


def aperture_samples(spark, sf):
    """The table's samples with the pointing of each field's feeds, which moves once, and w planes."""
    late = F.col("time_s") >= 1998 * 12 * 31 * 86400.0
    s = _samples(spark, sf, 2, 4).withColumnRenamed("feed1", "feed").withColumns({
        "l": 0.004 * (F.col("feed") - 3) + F.when(late, 0.002).otherwise(0.0), "m": 0.001 * (F.col("field_id") % 5), "pa": F.lit(0.1) * (F.col("field_id") % 2),
        "wp": P.w_plane("w", 50.0, 5, clip=True)})
    return AP.with_bands(AP.with_epochs(s, 0.001, 0.05, 366 * 86400.0), 8e6)


@query("grid_a_w_stack")
def grid_a_w_stack(spark, sf):
    """Kernels by field, feed, epoch of pointing and band, made where they are needed; one grid a w plane."""
    s = aperture_samples(spark, sf).where("wp >= 0")
    g = AP.gridded(s, AP.kernels(s, dish, 1.0, 2, 4), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol", "wp"])
    return g.select("pol", "wp", "gu", "gv", *[rnd(c, 5).alias(c) for c in ("re", "im", "weight")])


def delay_of(antenna):
    """Delays (s) of the antennas in antenna_delay_solve."""
    return ((antenna * 5) % 11 - 5) * 2e-8


def delayed_samples(spark, sf):
    v = table(spark, sf, "vis")
    phase = 2 * math.pi * (F.col("freq") - 1.1e9) * (delay_of(F.col("antenna1")) - delay_of(F.col("antenna2")))
    z = Cx.polar(F.lit(1.0), phase) + Cx.of("re", "im") * NOISE
    return v.withColumns({"re": z.re, "im": z.im})


@query("antenna_delay_solve")
def antenna_delay_solve(spark, sf):
    """Delays of all antennas from lags of baselines, with the table's values as noise."""
    b = Y.baseline_delays(Y.spectra(delayed_samples(spark, sf), [], 1, 5.0), [], CHANNELS, 1e6).where("n_chan > 2")
    return Y.antenna_delays(b, [], 0, 0.5).select("antenna", rnd(F.col("delay") * 1e9, 3).alias("delay_ns"), "n_baselines")


_OP = f""", c AS (SELECT DISTINCT CAST(floor(time_s / 3600) AS BIGINT) AS cycle FROM ts), s AS (SELECT CAST(k % 7 AS INTEGER) AS beam, CAST(k AS INTEGER) AS scan, k * 30 AS first, k * 30 + 100 AS last FROM range(0, 25) t(k)),
m AS (SELECT cycle, beam, min(scan) AS scan FROM c JOIN s ON cycle BETWEEN first AND last GROUP BY cycle, beam),
p AS (SELECT c.cycle, coalesce(string_agg(beam || ':' || scan, ' ' ORDER BY beam), '') AS beams FROM c LEFT JOIN m USING (cycle) GROUP BY c.cycle),
d AS (SELECT *, CASE WHEN lag(beams) OVER (ORDER BY cycle) = beams THEN 0 ELSE 1 END AS cut FROM p), o AS (SELECT cycle, beams, sum(cut) OVER (ORDER BY cycle) AS chunk FROM d)"""


def _op_scans(spark):
    k = F.col("id")
    return spark.range(25).select(F.lit("events").alias("dataset"), (k % 7).cast("int").alias("beam"), k.cast("int").alias("scan"), (k * 30).alias("first"), (k * 30 + 100).alias("last"))


def op_chunks(spark, sf):
    cycles = table(spark, sf, "ts").select(F.lit("events").alias("dataset"), F.floor(F.col("time_s") / 3600).cast("long").alias("cycle"))
    return OP.chunks(cycles, _op_scans(spark), 24 * 30)


@query("opcal_chunks", ctes("ts") + _OP + " SELECT CAST(chunk AS INTEGER) AS chunk, min(cycle) AS first, max(cycle) AS last, count(*) AS n_cycles, any_value(beams) AS beams FROM o GROUP BY chunk")
def opcal_chunks(spark, sf):
    """Stretches of cycles over which every beam stays in its scan."""
    beams = F.array_join(F.transform(F.sort_array(F.map_entries("beams")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    o = op_chunks(spark, sf).withColumn("beams", beams)
    return o.groupBy("chunk").agg(F.min("cycle").alias("first"), F.max("cycle").alias("last"), F.count(F.lit(1)).alias("n_cycles"), F.first("beams").alias("beams"))


def op_gain(antenna, beam) -> Cx:
    return Cx.polar(1 + 0.03 * ((antenna + beam) % 4), 0.15 * ((antenna * 3 + beam) % 5) - 0.3)


@query("opcal_gains")
def opcal_gains(spark, sf):
    """Gains of every beam's part of every chunk, from samples that went through known ones with the table's values as noise."""
    v = table(spark, sf, "vis_pol").where("NOT flag AND pol = 0")
    z = op_gain(F.col("antenna1"), F.col("beam")) * op_gain(F.col("antenna2"), F.col("beam")).conj() + Cx.of("re", "im") * 0.1
    s = v.select(F.lit("events").alias("dataset"), F.floor(F.col("time_s") / 3600).cast("long").alias("cycle"), "beam", "antenna1", "antenna2", z.re.alias("re"), z.im.alias("im"), F.lit(1.0).alias("m_re"), F.lit(0.0).alias("m_im"))
    out = OP.solved(s, op_chunks(spark, sf), F.lit(1.0), ANTENNAS)
    return out.select("chunk", "beam", "scan", "antenna", rnd("amplitude", 3).alias("amplitude"), rnd("phase", 3).alias("phase"), "valid")


#: A Gaussian and a point; where the fit begins.
TRUE_SOURCES = [{"flux": 3.0, "l": 2e-4, "m": -1e-4, "alpha": 0.0, "f0": 1.1e9, "bmaj": 2e-4, "bmin": 1e-4, "bpa": 0.6}, {"flux": 1.0, "l": -3e-4, "m": 4e-4, "alpha": 0.0, "f0": 1.1e9}]
FIRST_SOURCES = [{**TRUE_SOURCES[0], "flux": 2.5, "l": 2.1e-4, "m": -9e-5, "bmaj": 1.7e-4, "bmin": 1.2e-4, "bpa": 0.4}, {**TRUE_SOURCES[1], "flux": 1.3, "l": -3.1e-4}]
FREE = [(0, n) for n in ("flux", "l", "m", "bmaj", "bmin", "bpa")] + [(1, n) for n in ("flux", "l", "m")]


def component_samples(spark, sf):
    """Samples of two sources; the table's values with either sign are noise of mean 0."""
    z = Cx.of("re", "im") * ((1.0 - 2.0 * F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(2))) * NOISE)
    for c in TRUE_SOURCES:
        z = z + CO.visibility(c)
    return table(spark, sf, "vis", G.spread).where("NOT flag AND sigma > 0").select("u", "v", "w", "freq", "sigma", z.re.alias("re"), z.im.alias("im"))


@query("component_fit")
def component_fit(spark, sf):
    """Fluxes, places and widths of two sources from samples with the table's values as noise, with their errors."""
    fit = CO.fitted(component_samples(spark, sf), FIRST_SOURCES, FREE, P.noise_weight("sigma"), 12)
    unit = {"flux": 1.0, "bpa": 1.0}  # directions and widths in microradians
    rows = [(i, n, float(fit.components[i][n]) * unit.get(n, 1e6), fit.errors[i, n] * unit.get(n, 1e6)) for i, n in FREE]
    return spark.createDataFrame(rows, "source int, parameter string, value double, error double").select("source", "parameter", rnd("value", 3).alias("value"), rnd("error", 3).alias("error"))


def rippled_spectra(spark, sf):
    """Spectra of 36 antennas and 2 polarisations with a slope and a ripple over the whole band, small noise of the table's and a line in two channels."""
    c = F.col("chan") / F.lit(float(CHANNELS))
    v = table(spark, sf, "vis").groupBy("antenna1", "pol", "chan").agg(F.avg(F.when(~F.col("flag"), F.col("re"))).alias("re"), F.avg(F.when(~F.col("flag"), F.col("im"))).alias("im"))
    ripple = 2 + 0.5 * c + 0.4 * F.sin(math.pi * c) + F.when(F.col("chan").isin(6, 7), 3.0).otherwise(0.0)
    noise = lambda x: 0.002 * F.coalesce(F.col(x), F.lit(0.0))
    return v.select("antenna1", "pol", "chan", (ripple + noise("re")).alias("re"), (-ripple + noise("im")).alias("im"), F.col("re").isNull().alias("flag"))


@query("vis_contsub_harmonic")
def vis_contsub_harmonic(spark, sf):
    """A slope and a ripple taken out of every spectrum by one robust fit; the line stays."""
    return CN.subtracted(rippled_spectra(spark, sf), ["antenna1", "pol"], CHANNELS, 1, 1, threshold=2.5).withColumns({c: rnd(c, 4) for c in ("re", "im")})


@query("deconvolve_fista_redundant")
def deconvolve_fista_redundant(spark, sf):
    """The planes deconvolved over resolutions, lambda falling by the gain."""

    def work(a):
        top = a["psf"][32, 32]
        if not top > 0:
            return {"model": a["dirty"] * 0, "residual": a["dirty"]}
        model, residual, _, _ = D.fista_redundant(a["dirty"] / top, a["psf"] / top, [1.0, 2.0, 4.0], D.Control(30, 0.2, fraction=0.05))
        return {"model": model, "residual": residual}

    return D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["model", "residual"]).withColumns({c: rnd(c) for c in ("model", "residual")})


@query("precondition_tuned_taper")
def precondition_tuned_taper(spark, sf):
    """The planes with a taper that makes their beam 8 by 6 pixels, where it isn't wider already."""

    def work(a):
        out = TP.tuned_taper(a["psf"], a["dirty"], (8.0, 6.0, 0.5)) if a["psf"].max() > 0 else None
        return {"psf_out": a["psf"] if out is None else out.psf, "dirty_out": a["dirty"] if out is None else out.dirty}

    return D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["psf_out", "dirty_out"]).withColumns({c: rnd(c) for c in ("psf_out", "dirty_out")})


@query("precondition_norm_wiener")
def precondition_norm_wiener(spark, sf):
    """The planes through the normalised Wiener filter."""

    def work(a):
        psf, dirty = TP.normalised_wiener(a["psf"], a["dirty"], -0.5) if a["psf"].max() > 0 else (a["psf"], a["dirty"])
        return {"psf_out": psf, "dirty_out": dirty}

    return D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["psf_out", "dirty_out"]).withColumns({c: rnd(c) for c in ("psf_out", "dirty_out")})


def _jones_sql(a: str) -> str:
    """The columns of an antenna's matrix, row by row: gains on the diagonal, each receptor's leakage through its gain."""
    amp, turn = (f"(1 + 0.02 * ({a} % 5))", f"(0.9 + 0.01 * ({a} % 3))"), (f"(0.1 * ({a} % 7))", f"(-0.05 * ({a} % 4))")
    g = [(f"{x} * cos({t})", f"{x} * sin({t})") for x, t in zip(amp, turn, strict=True)]
    d12, d21 = (f"(0.01 * ({a} % 5))", f"(0.02 * ({a} % 3))"), (f"(-0.015 * ({a} % 4))", f"(0.01 * ({a} % 2))")
    out = {"0": g[0], "1": _times(g[0], d12), "2": tuple(f"-({x})" for x in _times(g[1], d21)), "3": g[1]}
    return ", ".join(f"{x} AS {a[0]}{a[-1]}{k}{c}" for k, z in out.items() for c, x in zip("ri", z, strict=True))


def _times(x, y) -> tuple[str, str]:
    return f"({x[0]}) * ({y[0]}) - ({x[1]}) * ({y[1]})", f"({x[0]}) * ({y[1]}) + ({x[1]}) * ({y[0]})"


def _sum(*z) -> tuple[str, str]:
    return " + ".join(f"({x[0]})" for x in z), " + ".join(f"({x[1]})" for x in z)


_col = lambda name: (f"{name}r", f"{name}i")
_conj = lambda z: (z[0], f"-({z[1]})")
#: Of two-by-two matrices in rows: first the left product, then with the conjugate transpose of the right one.
_LEFT = ", ".join(f"{x} AS l{2 * i + k}{c}" for i in (0, 1) for k in (0, 1) for c, x in zip("ri", _sum(_times(_col(f"a1{2 * i}"), _col(f"v{k}")), _times(_col(f"a1{2 * i + 1}"), _col(f"v{2 + k}"))), strict=True))
_RIGHT = ", ".join(f"{x} AS o{2 * i + k}{c}" for i in (0, 1) for k in (0, 1) for c, x in zip("ri", _sum(_times(_col(f"l{2 * i}"), _conj(_col(f"a2{2 * k}"))), _times(_col(f"l{2 * i + 1}"), _conj(_col(f"a2{2 * k + 1}")))), strict=True))
_WIDE = ", ".join(f"max({n}) FILTER (pol = {k}) AS v{k}{c}" for k in range(4) for n, c in (("re", "r"), ("im", "i")))


@query("mueller_corrupted", ctes("ts", "vis_pol") + f", w AS (SELECT row_id, antenna1, antenna2, {_WIDE} FROM vis_pol GROUP BY row_id, antenna1, antenna2), j AS (SELECT *, {_jones_sql('antenna1')}, {_jones_sql('antenna2')} FROM w), l AS (SELECT *, {_LEFT} FROM j), o AS (SELECT row_id, {_RIGHT} FROM l) "
       + " UNION ALL ".join(f"SELECT row_id, {k} AS pol, {r(f'o{k}r', 4)} AS re, {r(f'o{k}i', 4)} AS im FROM o" for k in range(4)))
def mueller_corrupted(spark, sf):
    """All four polarisations through the gains and leakages of both antennas; the other side is the products written out."""
    from .extras import _jones

    cell = lambda c, k: F.max(F.when(F.col("pol") == k, F.col(c)))
    wide = table(spark, sf, "vis_pol").groupBy("row_id", "antenna1", "antenna2").agg(*[cell(c, k).alias(f"{c}{k}") for k in range(4) for c in ("re", "im")])
    rows, j1 = Z.staged(wide, "j1", _jones("antenna1"))
    rows, j2 = Z.staged(rows, "j2", _jones("antenna2"))
    seen = Z.corrupted(tuple(Cx.of(f"re{k}", f"im{k}") for k in range(4)), j1, j2)
    cells = F.array(*[F.struct(F.lit(k).alias("pol"), rnd(z.re, 4).alias("re"), rnd(z.im, 4).alias("im")) for k, z in enumerate(seen)])
    return rows.select("row_id", F.inline(cells))


_BEAM_GAINS = ", g AS (SELECT antenna, beam, 1 + avg(value) / 1000 AS gr, avg(value) / 2000 AS gi, count(*) FILTER (NOT flag) > 0 AS ok FROM ts GROUP BY antenna, beam)"


@query("apply_beam_independent", ctes("ts", "vis_pol") + _BEAM_GAINS + f""", v AS (SELECT v.*, coalesce(a.ok AND b.ok, FALSE) AS good, a.gr * b.gr + a.gi * b.gi AS gr, a.gi * b.gr - a.gr * b.gi AS gi FROM vis_pol v LEFT JOIN g a ON a.antenna = v.antenna1 AND a.beam = 0 LEFT JOIN g b ON b.antenna = v.antenna2 AND b.beam = 0 WHERE v.pol = 0)
SELECT row_id, beam, CASE WHEN good AND NOT flag THEN {r('(re * gr + im * gi) / (gr * gr + gi * gi)')} ELSE 0.0 END AS re, CASE WHEN good AND NOT flag THEN {r('(im * gr - re * gi) / (gr * gr + gi * gi)')} ELSE 0.0 END AS im, flag OR NOT good AS flag FROM v""")
def apply_beam_independent(spark, sf):
    """Beam 0's gains applied to the samples of all beams; samples without them are flagged."""
    g = table(spark, sf, "ts").groupBy("antenna", "beam").agg((1 + F.avg("value") / 1000).alias("g11_re"), (F.avg("value") / 2000).alias("g11_im"), (F.count_if(~F.col("flag")) > 0).alias("valid"))
    g = g.withColumns({"chan": F.lit(0), "g22_re": F.col("g11_re"), "g22_im": F.col("g11_im"), **{f"{d}_{c}": F.lit(0.0) for d in ("d12", "d21") for c in ("re", "im")}})
    rows, j1, j2, ok = Z.with_solutions(table(spark, sf, "vis_pol").where("pol = 0"), g, beam_independent=True, channel_independent=True)
    none = Cx.of(0.0)
    out = Z.applied(rows, (Cx.of("re", "im"), none, none, none), j1, j2, ok, F.col("flag"))
    return out.select("row_id", "beam", rnd("v0_re").alias("re"), rnd("v0_im").alias("im"), "flag")
