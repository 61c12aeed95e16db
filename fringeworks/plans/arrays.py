"""Array-tier, text and streaming queries. Without a SQL twin unless given; tests hold them against identities and closed forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.names import gain_name
from ..functions.scalar import rnd
from ..operators import calibrate as K
from ..operators import deconv as D
from ..operators import gridding as G
from ..operators import illumination as L
from ..operators import images as I  # noqa: E741
from ..operators import select as P
from ..operators import simulate as M
from ..operators import taylor as Y
from ..sources import text as T
from ..sources.driver_tables import ctes, table
from ..streaming import solutions as Z
from .imaging import _DELAY, _known_products, _planes, _samples, kernel_grid_sql, known_gain_sql  # noqa: F401
from .registry import query, r


def _clean(spark, sf, work):
    def safe(a):
        k = a["psf"][32, 32]
        if k <= 0 or not np.isfinite(k):
            return {"model": a["dirty"] * 0, "residual": a["dirty"]}
        model, residual = work(a["dirty"] / k, a["psf"] / k)
        return {"model": model, "residual": residual}

    return D.per_plane(_planes(spark, sf), ["pol"], 64, safe, ["dirty", "psf"], ["model", "residual"]).withColumns({c: rnd(c) for c in ("model", "residual")})


@query("clean_multi_scale")
def clean_multi_scale(spark, sf):
    def work(dirty, psf):
        model, residual, _ = D.multi_term([dirty], [psf], [0.0, 3.0], D.Control(15, 0.1))
        return model[0], residual[0]

    return _clean(spark, sf, work)


@query("clean_multi_term")
def clean_multi_term(spark, sf):
    """The table's samples with wide channels: two terms cleaned on the equations that they have themselves."""
    s = _samples(spark, sf).withColumn("freq", 1.4e9 + 4e7 * (F.col("chan") - 8))
    cells = Y.equations(s, G.kernel_table(spark, G.box_kernel()), Cx.of("re", "im").conj(), Y.offset("freq", 1.4e9), P.noise_weight("sigma"), ["pol"], 2)

    def work(a):
        top = a["psf0"][32, 32]
        if not top > 0:
            return {"model": a["dirty0"] * 0, "model1": a["dirty0"] * 0, "residual": a["dirty0"]}
        model, residual, _ = D.multi_term([a[f"dirty{t}"] / top for t in range(2)], [a[f"psf{t}"] / top for t in range(3)], [0.0, 3.0], D.Control(8, 0.1), "MAXCHISQ")
        return {"model": model[0], "model1": model[1], "residual": residual[0]}

    planes = Y.images(cells, ["pol"], 64, 2)
    return D.per_plane(planes, ["pol"], 64, work, ["dirty0", "dirty1", "psf0", "psf1", "psf2"], ["model", "model1", "residual"]).withColumns({c: rnd(c) for c in ("model", "model1", "residual")})


@query("deconvolve_fista")
def deconvolve_fista(spark, sf):
    def work(dirty, psf):
        model = D.fista(dirty, psf, 0.01 * float(np.abs(dirty).max()), 20)
        return model, dirty - D.fft_convolve(model, psf)

    return _clean(spark, sf, work)


@query("deconvolve_entropy")
def deconvolve_entropy(spark, sf):
    def work(dirty, psf):
        model, _ = D.maximum_entropy(dirty, psf, 0.1 * float(np.abs(dirty).max()), 0.02 * float(np.abs(dirty).max()), 30)
        return model, dirty - D.fft_convolve(model, psf)

    return _clean(spark, sf, work)


def _filtered(spark, sf, work):
    return D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["psf", "dirty"])


@query("precondition_wiener")
def precondition_wiener(spark, sf):
    def work(a):
        p, d = D.wiener_filter(a["psf"] + 1e-12, a["dirty"], 0.1)
        return {"psf": p, "dirty": d}

    return _filtered(spark, sf, work).withColumns({c: rnd(c) for c in ("psf", "dirty")})


@query("precondition_taper")
def precondition_taper(spark, sf):
    def work(a):
        p, d = D.gaussian_taper(a["psf"] + 1e-12, a["dirty"], 3.0)
        return {"psf": p, "dirty": d}

    return _filtered(spark, sf, work).withColumns({c: rnd(c) for c in ("psf", "dirty")})


@query("psf_beam_fit")
def psf_beam_fit(spark, sf):
    """Fitted beam and the sensitivity lost by a taper, per polarisation."""
    import pandas as pd

    def run(key, pdf):
        a = np.zeros((64, 64))
        a[pdf["x"], pdf["y"]] = pdf["psf"]
        tapered, _ = D.gaussian_taper(a + 1e-12, a, 3.0)
        return pd.DataFrame([(key[0], *D.fit_beam(a), I.sensitivity_loss(a + 1e-12, tapered))], columns=["pol", "major", "minor", "angle", "loss"])

    out = _planes(spark, sf).select("pol", "x", "y", "psf").groupBy("pol").applyInPandas(run, "pol string, major double, minor double, angle double, loss double")
    return out.select("pol", *[rnd(c, 4).alias(c) for c in ("major", "minor", "angle", "loss")])


_AKERNEL = L.a_kernel_rows({f: L.offset(L.tapered(32, 1.0, 12.0, 2.0), 1.0, 0.01 * f, 0.0, 0.25) for f in range(7)}, 2, 4)


@query("grid_a_projection", kernel_grid_sql(_AKERNEL, "feed1", 2))
def grid_a_projection(spark, sf):
    """Kernels keyed by feed: the autocorrelation of its illumination."""
    rows = _samples(spark, sf, 2, 4).withColumn("plane", F.col("feed1"))
    g = G.gridded(rows, G.kernel_table(spark, _AKERNEL), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", *[rnd(c).alias(c) for c in ("re", "im", "weight")])


@query("w_stack_image")
def w_stack_image(spark, sf):
    """One transform per w plane, its phase screen, and the sum over planes."""
    import pandas as pd

    rows = _samples(spark, sf).withColumn("wp", P.w_plane("w", 50.0, 5, clip=True)).where("wp >= 0")
    g = G.gridded(rows, G.kernel_table(spark, G.box_kernel()), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["wp", "pol"], psf=False)

    def run(key, pdf):
        n = 64
        z = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(G.dense(pdf, n)))) * n * n
        x, y = np.indices((n, n))
        l, m = (x - 32) / (n * 50.0), (y - 32) / (n * 50.0)  # noqa: E741
        w = (int(key[0]) - 2) * 50.0
        z = (z * np.exp(2j * math.pi * w * (1 - np.sqrt(1 - l * l - m * m)))).real
        return pd.DataFrame({"pol": key[1], "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "value": z.ravel()})

    return g.groupBy("wp", "pol").applyInPandas(run, "pol string, x int, y int, value double").groupBy("pol", "x", "y").agg(rnd(F.sum("value"), 3).alias("value"))


@query("snapshot_planes")
def snapshot_planes(spark, sf):
    v = table(spark, sf, "vis").withColumn("time_s", F.floor(F.col("time_s") / 8640000) * 8640000.0)
    return I.snapshot_segments(v, ["scan"], 60.0).select("scan", "time_s", "segment", rnd("a").alias("a"), rnd("b").alias("b"))


def _cube(spark, sf):
    """Pixels with a spectrum: y stands for the channel, the image number for the row."""
    return table(spark, sf, "image").select("x", (F.col("img")).alias("y"), F.col("y").alias("chan"), "value")


@query("image_contsub")
def image_contsub(spark, sf):
    return I.image_continuum_subtracted(_cube(spark, sf), 1).withColumn("value", rnd("value"))


@query("image_contsub_blocks")
def image_contsub_blocks(spark, sf):
    return I.image_continuum_subtracted(_cube(spark, sf), 1, block=16, interleave=True).withColumn("value", rnd("value"))


@query("vis_contsub_poly")
def vis_contsub_poly(spark, sf):
    s = table(spark, sf, "vis").where("NOT flag").groupBy("antenna1", "pol", "chan").agg(F.avg("re").alias("re"))
    return K.continuum_fit(s, ["antenna1", "pol"], 2).withColumn("residual", rnd("residual"))


@query("regridded_image")
def regridded_image(spark, sf):
    def work(a):
        x, y = np.indices(a["dirty"].shape)
        c, s = math.cos(0.1), math.sin(0.1)
        u, v = c * (x - 32) - s * (y - 32) + 32, s * (x - 32) + c * (y - 32) + 32
        return {"linear": I.regrid(a["dirty"], u, v), "nearest": I.regrid(a["dirty"], u, v, "nearest")}

    return D.per_plane(_planes(spark, sf).select("pol", "x", "y", "dirty"), ["pol"], 64, work, ["dirty"], ["linear", "nearest"]).withColumns({c: rnd(c) for c in ("linear", "nearest")})


@query("beamforming_weights")
def beamforming_weights(spark, sf):
    v = table(spark, sf, "vis_pol").where("NOT flag").select("beam", "antenna1", "antenna2", "re", "im")
    both = v.unionByName(v.select("beam", F.col("antenna2").alias("antenna1"), F.col("antenna1").alias("antenna2"), "re", (-F.col("im")).alias("im")))
    return I.beamforming_weights(both, ["beam"], 36).withColumns({"w_re": rnd("w_re", 4), "w_im": rnd("w_im", 4)})


@query("baseline_solve", ctes("ts") + " SELECT DISTINCT antenna, round(0.01 * (antenna % 3), 5) AS dx, 0.0 AS dy, 0.0 AS dz, 0.2 AS \"offset\" FROM ts")
def baseline_solve(spark, sf):
    """Antenna positions recovered from phases that a known offset makes."""
    k = 2 * math.pi * 1.1e9 / S.C_LIGHT
    t = table(spark, sf, "ts").select("antenna", ((F.col("time_s") % 20000) / 20000 - 0.5).alias("ha"), (F.col("value") / 200 - 0.5).alias("dec"))
    phase = k * 0.01 * (F.col("antenna") % 3) * F.cos("dec") * F.cos("ha") + 0.2
    return K.baseline_offsets(t.withColumn("phase", phase), ["antenna"], 1.1e9).select("antenna", *[rnd(c, 5).alias(c) for c in ("dx", "dy", "dz", "offset")])


@query("pointing_solve", f"SELECT DISTINCT CAST(s_suppkey % 36 AS INTEGER) AS antenna, {r('(s_suppkey % 36) * 0.002', 5)} AS off_x, {r('(s_suppkey % 36) * -0.001', 5)} AS off_y, 3.0 AS peak FROM supplier")
def pointing_solve(spark, sf):
    """Five-point offsets per antenna, recovered from a round beam."""
    five = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0.0, 0.0), (0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5))])).alias("p")
    a = table(spark, sf, "supplier").select((F.col("s_suppkey") % 36).cast("int").alias("antenna")).distinct().select("antenna", five).select("antenna", "p.*")
    ex, ey = F.col("antenna") * 0.002, F.col("antenna") * -0.001
    amp = 3.0 * F.exp(-4 * math.log(2) * ((F.col("dx") - ex) * (F.col("dx") - ex) + (F.col("dy") - ey) * (F.col("dy") - ey)))
    return K.pointing_offsets(a.withColumn("amp", amp), ["antenna"], 1.0).select("antenna", *[rnd(c, 5).alias(c) for c in ("off_x", "off_y", "peak")])


@query("scan_calibration", ctes("vis") + known_gain_sql("vis", "scan", "NOT flag AND antenna1 <> antenna2 AND feed1 = feed2"))
def scan_calibration(spark, sf):
    """Samples of a calibrator averaged per scan and baseline, gains solved per scan: the gains that made them."""
    v = table(spark, sf, "vis").where("NOT flag AND antenna1 <> antenna2 AND feed1 = feed2")
    return K.solved_gains(_known_products(v, ["scan"], "scan"), ["scan"], 36).withColumns({"g_re": rnd("g_re", 5), "g_im": rnd("g_im", 5)})


_KEY = "(event_id * 4 + pol)"


@query("noise_added", ctes("ts", "vis_pol") + f""", u AS (SELECT beam, pol, antenna1 = antenna2 AS auto, {M.uniform_sql(_KEY, 11)} AS a, {M.uniform_sql(_KEY, 12)} AS b FROM (SELECT *, row_id AS event_id FROM vis_pol)),
n AS (SELECT beam, pol, 0.1 * sqrt(-2 * ln(1 - a)) * cos({2 * math.pi!r} * b) AS re, CASE WHEN auto THEN 0.0 ELSE 0.1 * sqrt(-2 * ln(1 - a)) * sin({2 * math.pi!r} * b) END AS im FROM u)
SELECT beam, pol, count(*) AS n_rows, {r('sum(re)', 4)} AS re, {r('sum(im)', 4)} AS im, {r('sqrt(avg(re * re))', 5)} AS rms FROM n GROUP BY beam, pol""")
def noise_added(spark, sf):
    """Noise that follows from a row's key and a seed, whatever the partitions; autocorrelations have none on the imaginary part."""
    v = table(spark, sf, "vis_pol").withColumns({"re0": F.col("re"), "im0": F.col("im")})
    n = M.with_noise(v, 0.1, 11, F.col("row_id") * 4 + F.col("pol"))
    re, im = F.col("re") - F.col("re0"), F.col("im") - F.col("im0")
    return n.groupBy("beam", "pol").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum(re), 4).alias("re"), rnd(F.sum(im), 4).alias("im"), rnd(F.sqrt(F.avg(re * re)), 5).alias("rms"))


@query("random_gains", ctes("ts") + f""", k AS (SELECT antenna, beam, p, (antenna * 7 + beam) * 4 + p AS id FROM (SELECT DISTINCT antenna, beam FROM ts), range(4) z(p)),
u AS (SELECT *, {M.uniform_sql('id', 5)} AS a, {M.uniform_sql('id', 6)} AS t FROM k)
SELECT 'gain.' || CASE p WHEN 0 THEN 'g11' WHEN 1 THEN 'g22' WHEN 2 THEN 'd12' ELSE 'd21' END || '.' || antenna || '.' || beam AS name, {r(f'CASE WHEN p < 2 THEN 0.8 + 0.4 * a ELSE 0.05 * a END * cos({2 * math.pi!r} * t)')} AS re, {r(f'CASE WHEN p < 2 THEN 0.8 + 0.4 * a ELSE 0.05 * a END * sin({2 * math.pi!r} * t)')} AS im FROM u""")
def random_gains(spark, sf):
    """Gains between two amplitudes and leakages up to a third, of random phase, for all antennas and beams seen."""
    g = M.random_gains(table(spark, sf, "ts"), 7, 0.8, 1.2, 5, leakage=0.05)
    return g.select(gain_name("kind", "antenna", "beam").alias("name"), rnd("re").alias("re"), rnd("im").alias("im"))


@query("gain_file_round_trip", ctes("ts", "gains") + f" SELECT 'g11' AS kind, antenna, CAST(0 AS INTEGER) AS beam, {r('avg(g_re)')} AS re, {r('avg(g_im)')} AS im FROM gains GROUP BY antenna")
def gain_file_round_trip(spark, sf):
    """Gains as lines of a gain file, parsed back."""
    g = table(spark, sf, "gains").groupBy("antenna").agg(F.avg("g_re").alias("re"), F.avg("g_im").alias("im")).select(F.lit("g11").alias("kind"), "antenna", F.lit(0).alias("beam"), "re", "im")
    return T.parsed_gains(T.gain_lines(g)).withColumns({"re": rnd("re"), "im": rnd("im")})


@query("sky_catalogue", f"SELECT 'Component' AS Type, {r('degrees(n_nationkey * 0.02)')} AS Long, {r('degrees(n_nationkey * 0.01 - 0.2)')} AS Lat, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS Annotation, CAST(n_nationkey + 1 AS DOUBLE) AS Flux FROM nation")
def sky_catalogue(spark, sf):
    n = F.col("n_nationkey")
    c = table(spark, sf, "nation").select(n.alias("number"), F.when(n % 2 == 0, "").otherwise(F.col("n_name")).alias("label"), (n * 0.02).alias("ra"), (n * 0.01 - 0.2).alias("dec"), (n + 1).cast("double").alias("flux"))
    return T.sky_catalogue(c).withColumns({"Long": rnd("Long"), "Lat": rnd("Lat")})


@query("stream_intervals", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_rows, count(*) FILTER (event_type <> 'error') AS n_good, {r('sum(value) FILTER (event_type <> ' + chr(39) + 'error' + chr(39) + ')', 3)} AS total FROM events GROUP BY 1")
def stream_intervals(spark, sf):
    out = Z.drained(Z.intervals(Z.event_stream(spark, sf)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_rows", "n_good", rnd("total", 3).alias("total"))


_CUT = "lag(event_id) OVER o IS NULL OR abs(t - lag(t) OVER o) > 1800 OR field <> lag(field) OVER o"


@query("stream_scan_sessions", f"""WITH e AS (SELECT event_id, CAST(user_id % 7 AS INTEGER) AS beam, user_id % 36 % 3 AS field, epoch_us(ts) / 1e6 AS t FROM events),
b AS (SELECT *, CASE WHEN {_CUT} THEN 1 ELSE 0 END AS cut FROM e WINDOW o AS (PARTITION BY beam ORDER BY t, event_id)), i AS (SELECT *, sum(cut) OVER (PARTITION BY beam ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT beam, {r('min(t)', 3)} AS begin_s, {r('max(t)', 3)} AS end_s, count(*) AS n FROM i GROUP BY beam, island""")
def stream_scan_sessions(spark, sf):
    """All scans of the stream at the end of its input: the closed ones, and of each beam the open one."""
    out = Z.latest_scans(Z.drained(Z.scan_sessions(Z.event_stream(spark, sf)), "update"))
    return out.select("beam", rnd("begin_s", 3).alias("begin_s"), rnd("end_s", 3).alias("end_s"), "n")
