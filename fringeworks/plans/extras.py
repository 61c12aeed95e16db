"""Queries over full-polarisation calibration, model subtraction, major cycles, mosaics with regridding, frames and definitions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import frames as V
from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.scalar import rnd
from ..operators import aggregates as A
from ..operators import cycle as Y
from ..operators import deconv as D
from ..operators import gridding as G
from ..operators import illumination as L
from ..operators import images as I  # noqa: E741
from ..operators import jones as Z
from ..operators import select as P
from ..sources import parset as C
from ..sources import text as T
from ..sources.driver_tables import ctes, table
from .imaging import _CV, _FLUX, _PHASE, COMPONENTS, _samples, kernel_grid_sql
from .registry import query, r
from .rows import nint_sql


def _jones(antenna: str) -> Z.Matrix:
    a = F.col(antenna)
    return Z.jones(Cx.polar(1 + 0.02 * (a % 5), 0.1 * (a % 7)), Cx.polar(0.9 + 0.01 * (a % 3), -0.05 * (a % 4)), Cx.of(0.01 * (a % 5), 0.02 * (a % 3)), Cx.of(-0.015 * (a % 4), 0.01 * (a % 2)))


@query("apply_mueller", ctes("ts", "vis_pol") + f" SELECT row_id, pol, CASE WHEN bad THEN 0.0 ELSE {r('re', 4)} END AS re, CASE WHEN bad THEN 0.0 ELSE {r('im', 4)} END AS im, bad AS flag FROM (SELECT *, max(flag) OVER (PARTITION BY row_id) AS bad FROM vis_pol)")
def apply_mueller(spark, sf):
    """Samples corrupted by known gains and leakages of both antennas, then calibrated: the samples again."""
    v = table(spark, sf, "vis_pol")
    cell = lambda c, k: F.max(F.when(F.col("pol") == k, F.col(c)))
    wide = v.groupBy("row_id", "antenna1", "antenna2").agg(F.max("flag").alias("bad"), *[cell(c, k).alias(f"{c}{k}") for k in range(4) for c in ("re", "im")])
    rows, j1 = Z.staged(wide, "j1", _jones("antenna1"))
    rows, j2 = Z.staged(rows, "j2", _jones("antenna2"))
    rows, seen = Z.staged(rows, "seen", Z.corrupted(tuple(Cx.of(f"re{k}", f"im{k}") for k in range(4)), j1, j2))
    out = Z.applied(rows, seen, j1, j2, F.lit(True), F.col("bad"))
    cells = F.array(*[F.struct(F.lit(k).alias("pol"), rnd(f"v{k}_re", 4).alias("re"), rnd(f"v{k}_im", 4).alias("im")) for k in range(4)])
    return out.select("row_id", F.inline(cells), "flag").select("row_id", "pol", "re", "im", "flag")


_D12, _D21 = ("0.01 * ({a} % 5)", "0.02 * ({a} % 3)"), ("-0.015 * ({a} % 4)", "0.01 * ({a} % 2)")
_of = lambda pair, a: tuple(x.format(a=a) for x in pair)


@query("leakage_solve", ctes("vis") + f""", live AS (SELECT DISTINCT scan, antenna FROM (SELECT scan, antenna1 AS antenna FROM vis WHERE antenna1 <> antenna2 UNION ALL SELECT scan, antenna2 FROM vis WHERE antenna1 <> antenna2)), f AS (SELECT scan, min(antenna) AS first FROM live GROUP BY scan)
SELECT scan, antenna, {r(f'{_of(_D12, "antenna")[0]} - {_of(_D12, "first")[0]}', 5)} AS d12_re, {r(f'{_of(_D12, "antenna")[1]} - {_of(_D12, "first")[1]}', 5)} AS d12_im, {r(f'{_of(_D21, "antenna")[0]} + {_of(_D12, "first")[0]}', 5)} AS d21_re, {r(f'{_of(_D21, "antenna")[1]} - {_of(_D12, "first")[1]}', 5)} AS d21_im FROM live JOIN f USING (scan)""")
def leakage_solve(spark, sf):
    """Leakages from the cross polarisations that they make on the baselines of each scan: the ones that made them."""
    d = lambda pair, a: Cx.of(*[F.expr(x.format(a=a)).cast("double") for x in pair])
    xy, yx = d(_D12, "antenna1") + d(_D21, "antenna2").conj(), d(_D21, "antenna1") + d(_D12, "antenna2").conj()
    p = table(spark, sf, "vis").where("antenna1 <> antenna2").groupBy("scan", "antenna1", "antenna2").agg(F.avg(xy.re).alias("xy_re"), F.avg(xy.im).alias("xy_im"), F.avg(yx.re).alias("yx_re"), F.avg(yx.im).alias("yx_im"))
    return Z.solved_leakages(p, ["scan"]).select("scan", "antenna", *[rnd(c, 5).alias(c) for c in ("d12_re", "d12_im", "d21_re", "d21_im")])


@query("ionosphere_solve", ctes("vis") + f" SELECT scan, {r('0.001 * (scan + 1)')} AS coeff_l, {r('-0.0005 * scan')} AS coeff_m FROM vis WHERE NOT flag GROUP BY scan")
def ionosphere_solve(spark, sf):
    """Ionospheric coefficients of every scan from the phases that they make."""
    v = table(spark, sf, "vis").where("NOT flag").select("scan", "freq", (F.col("u") / 1000).alias("dx"), (F.col("v") / 1000).alias("dy"))
    v = v.withColumn("phase", S.ionospheric_phase("freq", "dx", "dy", 0.001 * (F.col("scan") + 1), -0.0005 * F.col("scan")))
    return Z.solved_ionosphere(v, ["scan"]).select("scan", rnd("coeff_l").alias("coeff_l"), rnd("coeff_m").alias("coeff_m"))


_NAMES = ("flux", "l", "m", "bmaj", "bmin", "bpa", "alpha", "f0")


@query("cont_subtract_model", ctes("vis") + _CV + f""", s AS (SELECT scan, pol, sum({_FLUX} * cos({_PHASE})) AS re, sum({_FLUX} * sin({_PHASE})) AS im FROM vis, c WHERE NOT flag GROUP BY scan, pol), d AS (SELECT scan, pol, sum(re) AS re, sum(im) AS im FROM vis WHERE NOT flag GROUP BY scan, pol)
SELECT scan, pol, {r('d.re - s.re', 3)} AS re, {r('d.im - s.im', 3)} AS im FROM d JOIN s USING (scan, pol)""")
def cont_subtract_model(spark, sf):
    """A component model taken out of every sample, summed for the comparison."""
    v = Y.model_subtracted(table(spark, sf, "vis", G.spread).where("NOT flag"), [dict(zip(_NAMES, c, strict=True)) for c in COMPONENTS])
    return v.groupBy("scan", "pol").agg(rnd(F.sum("re"), 3).alias("re"), rnd(F.sum("im"), 3).alias("im"))


_SP = f"({2 * math.pi!r} * freq / {S.C_LIGHT!r} * (u * 0.0001 + v * 0.0002 + w * ({math.sqrt(1 - 1e-8 - 4e-8)!r} - 1)))"


@query("stokes_component", ctes("vis") + f", s AS (SELECT *, ['I', 'Q', 'U', 'V'][CAST(scan % 4 + 1 AS INTEGER)] AS stokes FROM vis) SELECT stokes, chan, count(*) AS n, CASE WHEN stokes = 'I' THEN {r(f'avg(2 * cos({_SP}))', 5)} ELSE 0.0 END AS re FROM s GROUP BY stokes, chan")
def stokes_component(spark, sf):
    """An unpolarised component over all samples, a quarter for each Stokes parameter: it has I only."""
    v = table(spark, sf, "vis").withColumn("stokes", F.element_at(F.array(*map(F.lit, Y.STOKES)), F.col("scan") % 4 + 1))
    z = Y.predicted([{"flux": 2.0, "l": 0.0001, "m": 0.0002}], "stokes")
    return v.groupBy("stokes", "chan").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(z.re), 5).alias("re"))


_SKY = [(20, 40, 2.0), (45, 30, 1.0), (33, 12, 0.5)]


@query("major_cycle")
def major_cycle(spark, sf):
    """Three sources seen by the cells that the table samples: the largest residual of each cycle, and the flux found."""
    s = _samples(spark, sf)
    phase = lambda x, y: 2 * math.pi / 64 * ((F.col("iu") - 32) * (x - 32) + (F.col("iv") - 32) * (y - 32))
    re, im = (sum(f * fn(phase(x, y)) for x, y, f in _SKY) for fn in (F.cos, F.sin))
    s = s.select("pol", "plane", "fracu", "fracv", "iu", "iv", "sigma", re.alias("re"), im.alias("im"))
    log, _ = Y.major_cycles(s, G.kernel_table(spark, G.box_kernel()), 64, ["pol"], P.noise_weight("sigma"), 3, lambda: D.Control(40, 0.3, fraction=0.2), stop=1e-3)
    return log.select("pol", "cycle", rnd("peak", 5).alias("peak"), rnd("flux", 4).alias("flux"))


_FOUR = " CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)"
_FX, _FY = "(img * 0.25 - floor(img * 0.25))", "(img * 0.4 - floor(img * 0.4))"
_SHARE = f"(CASE WHEN k.i = 1 THEN {_FX} ELSE 1 - {_FX} END * CASE WHEN k.j = 1 THEN {_FY} ELSE 1 - {_FY} END)"


@query("mosaic_regridded", ctes("image") + f""", g AS (SELECT img, CAST(x + floor(img * 0.25) + k.i AS INTEGER) AS x, CAST(y + floor(img * 0.4) + k.j AS INTEGER) AS y, sum(value * (1 + x / 64.0) * {_SHARE}) AS vw, sum((1 + x / 64.0) * {_SHARE}) AS w FROM image{_FOUR} WHERE {_SHARE} > 0 GROUP BY 1, 2, 3)
SELECT x, y, {r('sum(vw) / sum(w)', 5)} AS value, {r('sum(w)', 5)} AS weight FROM g GROUP BY x, y""")
def mosaic_regridded(spark, sf):
    """Images of unlike pixel grids: weighted, moved onto the common grid, added and divided by the weights."""
    i = table(spark, sf, "image").withColumn("w", 1 + F.col("x") / 64.0).withColumns({"vw": F.col("value") * F.col("w"), "sx": F.col("img") * 0.25, "sy": F.col("img") * 0.4})
    g = I.regridded(i, ["img", "sx", "sy"], "sx", "sy", ["vw", "w"])
    return g.groupBy("x", "y").agg(rnd(F.sum("vw") / F.sum("w"), 5).alias("value"), rnd(F.sum("w"), 5).alias("weight"))


_LB = f"({-4 * math.log(2)!r}::DOUBLE * ((x - 32) * (x - 32) + 9) / 900.0)"


@query("linmos_beam_spectrum", ctes("image") + f", t AS (SELECT img, x, y, value AS t0, value * 0.5 AS t1, value * 0.25 AS t2, {_LB} AS big FROM image) SELECT img, x, y, {r('t0')} AS t0, {r('t1 - 2 * big * t0')} AS t1, {r('t2 - 2 * big * (t1 - 2 * big * t0) - (big + 2 * big * big) * t0')} AS t2 FROM t")
def linmos_beam_spectrum(spark, sf):
    """Taylor terms without the spectrum that the primary beam gives them."""
    x = F.col("x") - 32
    i = table(spark, sf, "image").select("img", "x", "y", F.col("value").alias("t0"), (F.col("value") * 0.5).alias("t1"), (F.col("value") * 0.25).alias("t2"), (-4 * math.log(2) * (x * x + 9) / 900.0).alias("big"))
    return i.select("img", "x", "y", *[rnd(c).alias(n) for n, c in zip(("t0", "t1", "t2"), S.beam_spectrum_removed(["t0", "t1", "t2"], "big"), strict=True)])


@query("linmos_leakage", ctes("image") + f" SELECT q.x, q.y, {r('q.value - i.value * (0.01 + 0.00002 * (q.x - 32) * (q.x - 32))')} AS value FROM image q JOIN image i ON i.x = q.x AND i.y = q.y + 0 AND i.img = q.img")
def linmos_leakage(spark, sf):
    """A polarisation image less Stokes I times the leakage pattern, here of the image into itself."""
    q = table(spark, sf, "image")
    i = q.select("img", "x", "y", F.col("value").alias("stokes_i"))
    x = F.col("x") - 32
    return q.join(i, ["img", "x", "y"]).select("x", "y", rnd(F.col("value") - F.col("stokes_i") * S.polynomial(x * x, (0.00002, 0.01))).alias("value"))


_AW = L.aw_kernel_rows({f: L.offset(L.tapered(32, 1.0, 12.0, 2.0), 1.0, 0.01 * f, 0.0, 0.25) for f in range(2)}, [-50.0, 0.0, 50.0], 0.02, 2, 4)


@query("grid_aw_projection", kernel_grid_sql(_AW, f"CAST(feed1 % 2 * 3 + least(greatest({nint_sql('w / 50.0')}, -1), 1) + 1 AS INTEGER)", 2))
def grid_aw_projection(spark, sf):
    """Kernels keyed by feed and w plane: illumination and phase screen together."""
    rows = _samples(spark, sf, 2, 4).withColumn("plane", (F.col("feed1") % 2 * 3 + F.least(F.greatest(F.round(F.col("w") / 50.0), F.lit(-1)), F.lit(1)) + 1).cast("int"))
    g = G.gridded(rows, G.kernel_table(spark, _AW), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", *[rnd(c).alias(c) for c in ("re", "im", "weight")])


_LAG = f"({2 * math.pi / 32!r} * (c.chan - 8) * (t.i - 16))"


@query("extracted_spectra", ctes("vis") + f""", c AS (SELECT antenna1, antenna2, chan, coalesce(avg(re) FILTER (NOT flag), 0) AS re, coalesce(avg(im) FILTER (NOT flag), 0) AS im FROM vis GROUP BY antenna1, antenna2, chan)
SELECT antenna1, antenna2, CAST(t.i AS INTEGER) AS place, {r(f'sum(re * cos({_LAG}) + im * sin({_LAG}))', 5)} AS re, {r(f'sum(im * cos({_LAG}) - re * sin({_LAG}))', 5)} AS im FROM c, range(32) t(i) GROUP BY antenna1, antenna2, t.i""")
def extracted_spectra(spark, sf):
    """Mean spectra of all baselines, padded to twice their channels and transformed to lags."""
    return I.extracted_spectra(table(spark, sf, "vis"), ["antenna1", "antenna2"], 16, 2, True).withColumns({"re": rnd("re", 5), "im": rnd("im", 5)})


@query("statistics_table", ctes("image") + f""", s AS (SELECT img, sqrt(avg(value * value)) AS rms, stddev_pop(value) AS std, avg(value) AS mean, quantile_cont(value, 0.01) AS onepc, quantile_cont(value, 0.5) AS median, max(value) AS hi, min(value) AS lo FROM image GROUP BY img),
m AS (SELECT img, quantile_cont(abs(value - s.median), 0.5) AS madfm FROM image JOIN s USING (img) GROUP BY img)
SELECT img AS "Channel", (1300.0 + img)::DOUBLE AS "Frequency", {r('1000 * mean', 4)} AS "Mean", {r('1000 * std', 4)} AS "Std", {r('1000 * median', 4)} AS "Median", {r('1000 * madfm', 4)} AS "MADFM", {r('1000 * onepc', 4)} AS "1%ile", {r('1000 * lo', 4)} AS "Min", {r('1000 * hi', 4)} AS "Max", {r('1000 * rms', 4)} AS "rms" FROM s JOIN m USING (img)""")
def statistics_table(spark, sf):
    """The table of statistics that goes beside an image cube, in its units."""
    s = A.image_statistics(table(spark, sf, "image"), ["img"]).withColumnRenamed("img", "chan").withColumn("freq", 1.3e9 + 1e6 * F.col("chan"))
    t = T.statistics_table(s)
    return t.select("Channel", "Frequency", *[rnd(F.col(f"`{c}`"), 4).alias(c) for c in t.columns[2:]])


@query("jones_parameters", ctes("ts", "gains") + f""", s AS (SELECT antenna, arg_max(g_re, time_s) AS re, arg_max(g_im, time_s) AS im, arg_max(valid, time_s) AS ok FROM gains GROUP BY antenna), k AS (SELECT DISTINCT antenna, beam FROM ts)
SELECT 'gain.g11.' || antenna || '.' || beam AS name, CASE WHEN ok AND beam < 4 THEN {r('re')} ELSE 1.0 END AS re, CASE WHEN ok AND beam < 4 THEN {r('im')} ELSE 0.0 END AS im FROM k JOIN s USING (antenna)
UNION ALL SELECT 'gain.g22.' || antenna || '.' || beam, 1.0, 0.0 FROM k UNION ALL SELECT 'leakage.' || d || '.' || antenna || '.' || beam, 0.0, 0.0 FROM k, (VALUES ('d12'), ('d21')) t(d)""")
def jones_parameters(spark, sf):
    """Parameters of all antennas and beams seen, from the latest solutions of four beams; the rest take their unit values."""
    g = table(spark, sf, "gains").groupBy("antenna").agg(F.max_by(F.struct("g_re", "g_im", "valid"), "time_s").alias("s"))
    g = g.select("antenna", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("beam"), F.lit("g11").alias("kind"), F.col("s.g_re").alias("re"), F.col("s.g_im").alias("im"), F.col("s.valid").alias("valid"))
    return Z.jones_parameters(table(spark, sf, "ts"), g).select("name", rnd("re").alias("re"), rnd("im").alias("im"))


_SINB = f"(sin(lat) * {math.sin(math.radians(S.GALACTIC[1]))!r} + cos(lat) * {math.cos(math.radians(S.GALACTIC[1]))!r} * cos(lon - {math.radians(S.GALACTIC[0])!r}))"
_GL = f"({math.radians(S.GALACTIC[2])!r} - atan2(cos(lat) * sin(lon - {math.radians(S.GALACTIC[0])!r}), sin(lat) * {math.cos(math.radians(S.GALACTIC[1]))!r} - cos(lat) * {math.sin(math.radians(S.GALACTIC[1]))!r} * cos(lon - {math.radians(S.GALACTIC[0])!r})))"


@query("galactic_fields", f"WITH f AS (SELECT n_nationkey AS field_id, n_nationkey * 0.2 AS lon, n_nationkey * 0.1 - 1.2 AS lat FROM nation) SELECT field_id, {r(f'degrees({_GL} - {2 * math.pi!r} * floor({_GL} / {2 * math.pi!r}))')} AS lon, {r(f'degrees(asin({_SINB}))')} AS lat FROM f")
def galactic_fields(spark, sf):
    """J2000 directions of fields in the galactic frame."""
    n = F.col("n_nationkey")
    g = S.galactic(n * 0.2, n * 0.1 - 1.2)
    return table(spark, sf, "nation").select(n.alias("field_id"), rnd(F.degrees(g[0])).alias("lon"), rnd(F.degrees(g[1])).alias("lat"))


_H, _A = f"CAST(floor(n_nationkey * 0.2 * {12 / math.pi * 360000!r} + 0.5) AS BIGINT)", f"CAST(floor(abs(n_nationkey * 0.1 - 1.2) * {180 / math.pi * 360000!r} + 0.5) AS BIGINT)"
_T = "CAST(5e9 * 10 + n_nationkey * 123456 AS BIGINT)"


@query("formatted_observation", "SELECT n_nationkey AS field_id, " + f"strftime(DATE '1858-11-17' + CAST({_T} // 864000 AS INTEGER), '%d-%b-%Y') || printf('/%02d:%02d:%02d.%d', {_T} % 864000 // 36000, {_T} // 600 % 60, {_T} // 10 % 60, {_T} % 10) AS time, "
       + f"printf('%02d:%02d:%02d.%02d ', {_H} // 360000, {_H} // 6000 % 60, {_H} // 100 % 60, {_H} % 100) || CASE WHEN n_nationkey * 0.1 - 1.2 < 0 THEN '-' ELSE '+' END || printf('%02d.%02d.%02d.%02d', {_A} // 360000, {_A} // 6000 % 60, {_A} // 100 % 60, {_A} % 100) AS direction FROM nation")
def formatted_observation(spark, sf):
    """Times and directions as observation logs write them."""
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.alias("field_id"), S.time_text(5e9 + n * 12345.6).alias("time"), S.direction_text(n * 0.2, n * 0.1 - 1.2).alias("direction"))


@query("array_definition", "SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS antenna, 'pad' || k AS name, n * 0.5 AS x, hi * 0.5 AS y, lo * 0.5 AS z, 15.0 AS diameter, 'equatorial' AS mount FROM (SELECT s_suppkey % 36 AS k, count(*) AS n, max(s_suppkey) AS hi, min(s_suppkey) AS lo FROM supplier GROUP BY 1)")
def array_definition(spark, sf):
    """Antennas of the definition that the 36 groups of suppliers make, written out and read again."""
    pads = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 36).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("s_suppkey").alias("hi"), F.min("s_suppkey").alias("lo")).orderBy("k").collect()
    text = ["antennas.telescope = test", f"antennas.test.names = [{', '.join(f'pad{p.k}' for p in pads)}]", "antennas.test.diameter = 15m   # a comment", "antennas.test.scale = 0.5"]
    text += [f"antennas.test.pad{p.k} = [{p.n}, {p.hi}, {p.lo}]" for p in pads]
    return spark.createDataFrame([tuple(a.values()) for a in C.antennas(C.parse("\n".join(text)))], "antenna int, name string, x double, y double, z double, diameter double, mount string")


@query("smeared_image")
def smeared_image(spark, sf):
    """The planes as a radially averaged transform shows them."""
    from .imaging import _planes

    return D.per_plane(_planes(spark, sf), ["pol"], 64, lambda a: {"value": I.radially_smeared(a["dirty"])}, ["dirty"], ["value"]).withColumn("value", rnd("value"))


@query("time_string_split", "SELECT CAST(user_id % 36 AS INTEGER) AS antenna, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_flagged FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 10:30:00' AND TIMESTAMP '2024-01-20 18:00:00.5' GROUP BY 1")
def time_string_split(spark, sf):
    """Rows between two times that a configuration gives as calendar strings."""
    ts = F.col("ts")
    seconds = F.date_diff(F.to_date(ts), F.lit("1858-11-17").cast("date")) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.expr("EXTRACT(SECOND FROM ts)").cast("double")
    rows = table(spark, sf, "events").select((F.col("user_id") % 36).cast("int").alias("antenna"), (F.col("event_type") == "error").alias("flag"), seconds.alias("time_s"))
    rows = C.selection({"timebegin": "5jan2024/10:30:00", "timeend": "2024-01-20/18:00:00.5"})(rows)
    return rows.groupBy("antenna").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("flag").alias("n_flagged"))


#: The place of the observer in frequency_frames and the step of its channels: metres from the axis, Hz.
_SITE, _STEP = (-2.55e6, 5.1e6), 18500.0
_TILT, _APEX = math.radians(V.OBLIQUITY), [V.LSRK[0] * c for c in (math.cos(math.radians(V.LSRK[2])) * math.cos(math.radians(V.LSRK[1])), math.cos(math.radians(V.LSRK[2])) * math.sin(math.radians(V.LSRK[1])), math.sin(math.radians(V.LSRK[2])))]
_FRAMES_SQL = ctes("vis") + f""", a AS (SELECT field_id, scan, freq, field_id * 0.2 AS ra, field_id * 0.1 - 1.2 AS de, (time_s - 5.9e10) / 86400e0 - {V.J2000!r} AS n FROM vis),
 b AS (SELECT *, radians({V.SUN_ANOMALY[0]!r} + {V.SUN_ANOMALY[1]!r} * n) AS g, radians({V.SUN_LONGITUDE[0]!r} + {V.SUN_LONGITUDE[1]!r} * n) AS mean, radians({V.EARTH_TURN[0]!r} + {V.EARTH_TURN[1]!r} * n) AS th FROM a),
 c AS (SELECT *, mean + radians({V.CENTRE[0]!r} * sin(g) + {V.CENTRE[1]!r} * sin(2 * g)) AS lam, {V.DISTANCE[0]!r} + {V.DISTANCE[1]!r} * cos(g) + {V.DISTANCE[2]!r} * cos(2 * g) AS r,
  radians({V.SUN_LONGITUDE[1]!r} + radians({V.SUN_ANOMALY[1]!r}) * ({V.CENTRE[0]!r} * cos(g) + 2 * {V.CENTRE[1]!r} * cos(2 * g))) AS dlam, -radians({V.SUN_ANOMALY[1]!r}) * ({V.DISTANCE[1]!r} * sin(g) + 2 * {V.DISTANCE[2]!r} * sin(2 * g)) AS dr FROM b),
 d AS (SELECT *, -(dr * cos(lam) - r * dlam * sin(lam)) * {V.AU / 86400!r} AS ex, -(dr * sin(lam) + r * dlam * cos(lam)) * {V.AU / 86400!r} AS ey FROM c),
 e AS (SELECT *, (ex - {V.EARTH_RATE!r} * ({_SITE[0]!r} * sin(th) + {_SITE[1]!r} * cos(th)) + {_APEX[0]!r}) * cos(de) * cos(ra) + (ey * {math.cos(_TILT)!r} + {V.EARTH_RATE!r} * ({_SITE[0]!r} * cos(th) - {_SITE[1]!r} * sin(th)) + {_APEX[1]!r}) * cos(de) * sin(ra) + (ey * {math.sin(_TILT)!r} + {_APEX[2]!r}) * sin(de) AS vel FROM d)
SELECT field_id, scan, {r("avg(vel)", 3)} AS velocity, {r(f"avg(freq * (sqrt((1 - vel / {S.C_LIGHT!r}) / (1 + vel / {S.C_LIGHT!r})) - 1))", 2)} AS moved_hz,
 CAST(sum(round((freq - freq * sqrt((1 + vel / {S.C_LIGHT!r}) / (1 - vel / {S.C_LIGHT!r}))) / {_STEP!r})) AS BIGINT) AS shifts FROM e GROUP BY field_id, scan"""


@query("frequency_frames", _FRAMES_SQL)
def frequency_frames(spark, sf):
    """Mean velocity of the observer and shift of frequencies in the local standard of rest, per field and scan."""
    field = F.col("field_id")
    v = table(spark, sf, "vis").withColumn("vel", V.observer_velocity("LSRK", F.col("time_s") - 5.9e10, field * 0.2, field * 0.1 - 1.2, *_SITE))
    moved = V.to_frame("freq", F.col("vel")) - F.col("freq")
    out = v.groupBy("field_id", "scan").agg(F.avg("vel").alias("velocity"), F.avg(moved).alias("moved_hz"), F.sum(V.channel_shift("freq", F.col("vel"), _STEP)).alias("shifts"))
    return out.withColumns({"velocity": rnd("velocity", 3), "moved_hz": rnd("moved_hz", 2)})


@query("image_contsub_frame")
def image_contsub_frame(spark, sf):
    """Continuum taken out of a cube in the local standard of rest, over blocks that were steps of the observed spectrum."""
    rows = spark.range(256).select("id", V.channel_shift(1.4e9 + 1e4 * F.col("id"), V.observer_velocity("LSRK", F.lit(5.2e9), F.lit(0.4), F.lit(-0.9)), 1e4).alias("shift")).orderBy("id").collect()
    cube = table(spark, sf, "image").select("x", F.col("img").alias("y"), F.col("y").alias("chan"), "value")
    return I.image_continuum_subtracted(cube, 1, block=16, shift=[r.shift for r in rows]).withColumn("value", rnd("value"))
