"""Queries over gridding, prediction and image planes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.scalar import rnd
from ..operators import aggregates as A
from ..operators import calibrate as K
from ..operators import cycle as Y
from ..operators import deconv as D
from ..operators import gridding as G
from ..operators import select as P
from ..sources.driver_tables import ctes, table
from .registry import query, r
from .rows import cell_sql, nint_sql

C = S.C_LIGHT
_I, _J = cell_sql("(u / 50.0)", 1, 32)[0], cell_sql("(v / 50.0)", 1, 32)[0]
_BOX = f", s AS (SELECT *, {_I} AS gu, {_J} AS gv, 1.0 / (sigma * sigma) AS wt FROM vis WHERE NOT flag AND sigma > 0), g AS (SELECT pol, gu, gv, sum(re * wt) AS re, sum(-im * wt) AS im, sum(wt) AS weight FROM s WHERE gu > 0 AND gu < 64 AND gv > 0 AND gv < 64 GROUP BY pol, gu, gv)"


def _samples(spark, sf, support: int = 0, oversample: int = 1):
    """Unflagged samples with their cells on a 64 x 64 grid of 50-wavelength cells, off-grid ones left out."""
    rows = P.with_uv_cells(table(spark, sf, "vis", G.spread).where("NOT flag AND sigma > 0").withColumn("plane", F.lit(0)), 50.0, oversample, 64, wavelengths=True)
    return rows.where(P.on_grid("iu", "iv", support, 64, 64))


def _box_grid(spark, sf):
    return G.gridded(_samples(spark, sf), G.kernel_table(spark, G.KERNELS["box"]()), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol"])


@query("grid_box", ctes("vis") + _BOX + f" SELECT pol, gu, gv, {r('re')} AS re, {r('im')} AS im, {r('weight')} AS weight FROM g")
def grid_box(spark, sf):
    return _box_grid(spark, sf).select("pol", "gu", "gv", *[rnd(c).alias(c) for c in ("re", "im", "weight")])


@query("psf_grid", ctes("vis") + _BOX + f", f AS (SELECT min(feed1 * 1000 + field_id) AS k FROM s) SELECT pol, gu, gv, {r('sum(wt)')} AS psf FROM s, f WHERE feed1 * 1000 + field_id = f.k AND gu > 0 AND gu < 64 AND gv > 0 AND gv < 64 GROUP BY pol, gu, gv")
def psf_grid(spark, sf):
    """Unit responses of one representative feed and pointing: the first by (feed, field)."""
    rows = _samples(spark, sf)
    every = table(spark, sf, "vis").where("NOT flag AND sigma > 0")
    key = F.col("feed1") * 1000 + F.col("field_id")
    own = rows.join(every.agg(F.min(key).alias("k"))).where(key == F.col("k"))
    g = G.gridded(own, G.kernel_table(spark, G.box_kernel()), Cx.of(F.lit(1.0)), P.noise_weight("sigma"), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", rnd("re").alias("psf"))


@query("pcf_grid", ctes("vis") + _BOX + ", a AS (SELECT pol, gu, gv FROM s UNION ALL SELECT pol, 64 - gu, 64 - gv FROM s) SELECT pol, gu, gv, CAST(count(*) AS DOUBLE) AS weight FROM a WHERE gu > 0 AND gu < 64 AND gv > 0 AND gv < 64 GROUP BY pol, gu, gv")
def pcf_grid(spark, sf):
    """Unit weights laid down with their mirror images: the conjugate-symmetric preconditioner function."""
    rows = _samples(spark, sf)
    mirror = rows.withColumns({"iu": 64 - F.col("iu"), "iv": 64 - F.col("iv")})
    g = G.gridded(rows.unionByName(mirror), G.kernel_table(spark, G.box_kernel()), Cx.of(F.lit(1.0)), F.lit(1.0), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", F.round("weight", 6).alias("weight"))


_SPH = G.spheroidal_kernel(2, 4)


_KV = "(VALUES " + ", ".join(f"({fu},{fv},{du},{dv},{wr!r}::DOUBLE)" for _, fu, fv, du, dv, wr, _ in _SPH) + ") AS k(fu, fv, du, dv, wk)"


@query("grid_spheroidal", ctes("vis") + f", s AS (SELECT pol, re, im, 1.0 / (sigma * sigma) AS wt, {cell_sql('(u / 50.0)', 4, 32)[0]} AS iu, {cell_sql('(u / 50.0)', 4, 32)[1]} AS fu, {cell_sql('(v / 50.0)', 4, 32)[0]} AS iv, {cell_sql('(v / 50.0)', 4, 32)[1]} AS fv FROM vis WHERE NOT flag) SELECT pol, iu + du AS gu, iv + dv AS gv, {r('sum(re * wt * wk)', 5)} AS re, {r('sum(-im * wt * wk)', 5)} AS im, {r('sum(wt * wk)', 5)} AS weight FROM s JOIN {_KV} USING (fu, fv) WHERE iu - 2 > 0 AND iu + 2 < 64 AND iv - 2 > 0 AND iv + 2 < 64 GROUP BY pol, iu + du, iv + dv")
def grid_spheroidal(spark, sf):
    g = G.gridded(_samples(spark, sf, 2, 4), G.kernel_table(spark, _SPH), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", *[rnd(c, 5).alias(c) for c in ("re", "im", "weight")])


_WKERNEL = G.w_kernels(50.0, 5, 100.0, support=3, oversample=4, size=32)


def kernel_grid_sql(rows, plane: str, support: int, where: str = "TRUE") -> str:
    """The grid of a kernel of complex cells on 64 x 64 cells of 50 wavelengths, four steps a cell."""
    k = "(VALUES " + ", ".join(f"({p},{fu},{fv},{du},{dv},{a!r}::DOUBLE,{b!r}::DOUBLE)" for p, fu, fv, du, dv, a, b in rows) + ") AS k(plane, fu, fv, du, dv, a, b)"
    cells = ", ".join(f"{cell_sql(f'({c} / 50.0)', 4, 32)[i]} AS {n}{c}" for c in "uv" for i, n in ((0, "i"), (1, "f")))
    inside = " AND ".join(f"i{c} BETWEEN {support + 1} AND {63 - support}" for c in "uv")
    s = f", s AS (SELECT pol, re, -im AS im, 1.0 / (sigma * sigma) AS wt, {plane} AS plane, {cells} FROM vis WHERE NOT flag AND sigma > 0)"
    return ctes("vis") + s + f" SELECT pol, iu + du AS gu, iv + dv AS gv, {r('sum(wt * (re * a - im * b))')} AS re, {r('sum(wt * (re * b + im * a))')} AS im, {r('sum(wt * a)')} AS weight FROM s JOIN {k} USING (plane) WHERE k.fu = s.fu AND k.fv = s.fv AND {inside} AND {where} GROUP BY pol, iu + du, iv + dv"


@query("grid_w_projection", kernel_grid_sql(_WKERNEL, f"CAST({nint_sql('w / 50.0')} + 2 AS INTEGER)", 3))
def grid_w_projection(spark, sf):
    """Plane-dependent complex kernels; the kernel table is built on the driver, the rest is the same sum."""
    rows = _samples(spark, sf, 3, 4).withColumn("plane", P.w_plane("w", 50.0, 5, clip=True)).where("plane >= 0")
    g = G.gridded(rows, G.kernel_table(spark, _WKERNEL), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["pol"], psf=False)
    return g.select("pol", "gu", "gv", *[rnd(c).alias(c) for c in ("re", "im", "weight")])


@query("grid_w_stack", ctes("vis") + _BOX + f", p AS (SELECT *, CAST({nint_sql('w / 50.0')} + 2 AS INTEGER) AS plane FROM s) SELECT plane, pol, gu, gv, {r('sum(re * wt)')} AS re, {r('sum(-im * wt)')} AS im FROM p WHERE gu > 0 AND gu < 64 AND gv > 0 AND gv < 64 GROUP BY plane, pol, gu, gv")
def grid_w_stack(spark, sf):
    """One grid per w plane."""
    rows = _samples(spark, sf).withColumns({"wp": P.w_plane("w", 50.0, 5, clip=True)})
    g = G.gridded(rows, G.kernel_table(spark, G.box_kernel()), Cx.of("re", "im").conj(), P.noise_weight("sigma"), ["wp", "pol"], psf=False)
    return g.select(F.col("wp").alias("plane"), "pol", "gu", "gv", rnd("re").alias("re"), rnd("im").alias("im"))


@query("sum_of_weights", ctes("vis") + _BOX + f" SELECT pol, {r('sum(weight)', 3)} AS sum_weight, count(*) AS n_cells FROM g GROUP BY pol")
def sum_of_weights(spark, sf):
    return _box_grid(spark, sf).groupBy("pol").agg(rnd(F.sum("weight"), 3).alias("sum_weight"), F.count(F.lit(1)).alias("n_cells"))


@query("degrid_box", ctes("vis") + _BOX + f" SELECT s.scan, s.pol, count(*) AS n_rows, {r('sum(g.re)', 3)} AS re, {r('sum(-g.im)', 3)} AS im FROM s JOIN g USING (pol, gu, gv) GROUP BY s.scan, s.pol")
def degrid_box(spark, sf):
    out = G.degridded(_samples(spark, sf), G.kernel_table(spark, G.box_kernel()), _box_grid(spark, sf), ["pol"], ["scan", "pol"])
    return out.groupBy("scan", "pol").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("re"), 3).alias("re"), rnd(F.sum("im"), 3).alias("im"))


_PIX = ", px AS (SELECT CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, (i - 4) * 0.0005 AS l, (j - 4) * 0.0005 AS m FROM range(8) a(i), range(8) b(j))"


@query("dft_image", ctes("vis") + _PIX + f" SELECT pol, x, y, {r(f'sum(re * cos({2 * math.pi!r} * (u * l + v * m)) + im * sin({2 * math.pi!r} * (u * l + v * m))) / count(*)')} AS value FROM vis, px WHERE NOT flag GROUP BY pol, x, y")
def dft_image(spark, sf):
    px = G.local_rows(spark, [(i, j, (i - 4) * 0.0005, (j - 4) * 0.0005) for i in range(8) for j in range(8)], "x int, y int, l double, m double")
    return G.direct_image(table(spark, sf, "vis", G.spread).where("NOT flag"), px, ["pol"]).withColumn("value", rnd("value"))


COMPONENTS = [(float(i + 1), 0.001 * i - 0.003, 0.002 - 0.0007 * i, 0.002 + 0.0001 * i, 0.001, 0.3 * i, -0.7 if i % 2 else 0.0, 1.1e9) for i in range(8)]
_CV = ", c AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for x in c) + ")" for c in COMPONENTS) + ") AS t(flux, l, m, bmaj, bmin, bpa, alpha, f0))"
_FLUX = "(CASE WHEN alpha = 0 THEN flux ELSE flux * pow(freq / f0, alpha) END)"
_PHASE = f"({2 * math.pi!r} * freq * (l * u + m * v + (sqrt(1 - (l * l + m * m)) - 1) * w) / {C!r})"
_UP, _VP = f"((cos(bpa) * u + sin(bpa) * v) / {C!r})", f"((cos(bpa) * v - sin(bpa) * u) / {C!r})"
_DECAY = f"exp(-((bmaj * {_UP}) * (bmaj * {_UP}) + (bmin * {_VP}) * (bmin * {_VP})) * {math.pi**2 / (4 * math.log(2))!r} * freq * freq)"


def _predicted(spark, sf, gaussian: bool):
    """Component models summed per distinct geometry: rows with equal u, v, w and frequency are predicted once."""
    geo = table(spark, sf, "vis", G.spread).groupBy("u", "v", "w", "freq").agg(F.count(F.lit(1)).alias("n"))
    names = ("flux", "l", "m", "bmaj", "bmin", "bpa", "alpha", "f0")
    z = Y.predicted([dict(zip(names, c, strict=True)) | {"kind": "gaussian" if gaussian else "point"} for c in COMPONENTS])
    return geo.select("u", "v", "w", "freq", "n", rnd(z.re).alias("re"), rnd(z.im).alias("im"))


@query("predict_points", ctes("vis") + _CV + f" SELECT u, v, w, freq, n, {r(f'sum({_FLUX} * cos({_PHASE}))')} AS re, {r(f'sum({_FLUX} * sin({_PHASE}))')} AS im FROM (SELECT u, v, w, freq, count(*) AS n FROM vis GROUP BY u, v, w, freq), c GROUP BY u, v, w, freq, n")
def predict_points(spark, sf):
    return _predicted(spark, sf, False)


@query("predict_gaussian", ctes("vis") + _CV + f" SELECT u, v, w, freq, n, {r(f'sum({_FLUX} * {_DECAY} * cos({_PHASE}))')} AS re, {r(f'sum({_FLUX} * {_DECAY} * sin({_PHASE}))')} AS im FROM (SELECT u, v, w, freq, count(*) AS n FROM vis GROUP BY u, v, w, freq), c GROUP BY u, v, w, freq, n")
def predict_gaussian(spark, sf):
    return _predicted(spark, sf, True)


@query("flux_1934", ctes("vis") + f" SELECT mhz, count(*) AS n, {r('any_value(CASE WHEN mhz > 500 AND mhz < 10000 THEN pow(10.0, ((0.605334 * log10(mhz) + -7.0977) * log10(mhz) + 26.4908) * log10(mhz) + -30.7667) END)')} AS flux FROM (SELECT 1500 + u AS mhz FROM vis) GROUP BY mhz")
def flux_1934(spark, sf):
    """The calibrator's flux at every frequency that samples have (here 500 to 2500 MHz, from u), and how many have it."""
    v = table(spark, sf, "vis").groupBy((1500 + F.col("u")).alias("mhz")).agg(F.count(F.lit(1)).alias("n"))
    return v.select("mhz", "n", rnd(S.flux_1934("mhz")).alias("flux"))


@query("delay_correct", ctes("ts", "vis") + f" SELECT scan, chan, {r(f'sum(re * cos({2 * math.pi!r} * freq * w / 7 / {C!r}) + im * sin({2 * math.pi!r} * freq * w / 7 / {C!r}))', 3)} AS re, {r(f'sum(im * cos({2 * math.pi!r} * freq * w / 7 / {C!r}) - re * sin({2 * math.pi!r} * freq * w / 7 / {C!r}))', 3)} AS im FROM vis GROUP BY scan, chan")
def delay_correct(spark, sf):
    z = Cx.of("re", "im") * S.delay_phasor("freq", F.col("w") / 7).conj()
    return table(spark, sf, "vis").groupBy("scan", "chan").agg(rnd(F.sum(z.re), 3).alias("re"), rnd(F.sum(z.im), 3).alias("im"))


_JO, _WO = r("asin(sin(lon - 0.2) * cos(lat))", 9), r("asin(sin(lat) * cos(-0.1) - cos(lat) * sin(-0.1) * cos(lon - 0.2))", 9)


@query("angular_offsets", f"SELECT n_nationkey AS field_id, {_JO} AS offset_l, {_WO} AS offset_m FROM (SELECT n_nationkey, n_nationkey * 0.02 AS lon, n_nationkey * 0.01 - 0.2 AS lat FROM nation)")
def angular_offsets(spark, sf):
    a, b = S.offsets("lon", "lat", F.lit(0.2), F.lit(-0.1))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("field_id"), (F.col("n_nationkey") * 0.02).alias("lon"), (F.col("n_nationkey") * 0.01 - 0.2).alias("lat")).select("field_id", rnd(a, 9).alias("offset_l"), rnd(b, 9).alias("offset_m"))


_GAP = "sqrt(u * u + v * v)"
_A1, _A2 = f"acos(least(greatest(({_GAP} * {_GAP} + r1 * r1 - r2 * r2) / (2 * {_GAP} * r1), -1.0), 1.0))", f"acos(least(greatest(({_GAP} * {_GAP} + r2 * r2 - r1 * r1) / (2 * {_GAP} * r2), -1.0), 1.0))"
_LENS = f"(r1 * r1 * ({_A1} - sin({_A1}) * cos({_A1})) + r2 * r2 * ({_A2} - sin({_A2}) * cos({_A2})))"


def _share(own: str, other: str) -> str:
    return f"CASE WHEN {_GAP} >= r1 + r2 THEN 0.0 WHEN {_GAP} + least(r1, r2) <= greatest(r1, r2) THEN least(1.0, ({other} / {own}) * ({other} / {own})) ELSE {_LENS} / ({math.pi!r}::DOUBLE * {own} * {own}) END"


@query("dish_blockage", ctes("vis") + f", d AS (SELECT antenna1, antenna2, u / 50 + 0.1 AS u, v / 40 + 0.1 AS v, w, 6.0::DOUBLE AS r1, 5.5::DOUBLE AS r2 FROM vis) SELECT antenna1, antenna2, {r(f'max(CASE WHEN w < 0 THEN 0.0 ELSE {_share('r1', 'r2')} END)')} AS f1, {r(f'max(CASE WHEN w > 0 THEN 0.0 ELSE {_share('r2', 'r1')} END)')} AS f2 FROM d GROUP BY antenna1, antenna2")
def dish_blockage(spark, sf):
    """The largest shares of both dishes that the other one shades, over all samples of a baseline."""
    f1, f2 = S.blockage(F.col("u") / 50 + 0.1, F.col("v") / 40 + 0.1, "w", F.lit(12.0), F.lit(11.0))
    d = table(spark, sf, "vis").select("antenna1", "antenna2", f1.alias("f1"), f2.alias("f2"))
    return d.groupBy("antenna1", "antenna2").agg(rnd(F.max("f1")).alias("f1"), rnd(F.max("f2")).alias("f2"))


_LO, _LA = 2.03, -0.466


@query("antenna_positions", f"WITH a AS (SELECT CAST(s_suppkey % 36 AS INTEGER) AS antenna, min(s_acctbal) AS x, max(s_acctbal) AS y FROM supplier GROUP BY 1) SELECT antenna, {r(f'cos({_LO}) * (-sin({_LA}) * y + cos({_LA}) * 3.5) - sin({_LO}) * x', 4)} AS gx, {r(f'sin({_LO}) * (-sin({_LA}) * y + cos({_LA}) * 3.5) + cos({_LO}) * x', 4)} AS gy, {r(f'cos({_LA}) * y + sin({_LA}) * 3.5', 4)} AS gz FROM a")
def antenna_positions(spark, sf):
    a = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 36).cast("int").alias("antenna")).agg(F.min("s_acctbal").alias("x"), F.max("s_acctbal").alias("y"))
    x, y, z = S.local_to_global("x", "y", F.lit(3.5), _LO, _LA)
    return a.select("antenna", rnd(x, 4).alias("gx"), rnd(y, 4).alias("gy"), rnd(z, 4).alias("gz"))


@query("thermal_noise", ctes("vis") + f" SELECT chan, {r(f'1e26 * {math.sqrt(2)!r} * 1.38e-23 * (50 + chan) / 0.8 / (113.1 * sqrt(1e6 * 5.0))')} AS noise FROM (SELECT DISTINCT chan FROM vis)")
def thermal_noise(spark, sf):
    return table(spark, sf, "vis").select("chan").distinct().select("chan", rnd(S.thermal_noise(50 + F.col("chan"), F.lit(0.8), F.lit(113.1), F.lit(1e6), F.lit(5.0))).alias("noise"))


@query("taper_sigmas", f"SELECT p_partkey, {r(f'512.0 / p_size * {4 * math.log(2) / math.pi!r} / {math.sqrt(8 * math.log(2))!r}')} AS sigma FROM part")
def taper_sigmas(spark, sf):
    """Widths in uv pixels of tapers whose widths in image pixels a table gives."""
    return table(spark, sf, "part").select("p_partkey", rnd(S.taper_sigma(F.lit(512.0), "p_size")).alias("sigma"))


def _spheroidal_sql(end, p, q) -> str:
    poly = lambda c: "(" + " + ".join(f"{x!r}::DOUBLE * pow(nu * nu - {end * end!r}::DOUBLE, {k})" for k, x in enumerate(c)) + ")"
    return f"greatest({poly(p)} / {poly(q)}, 0.0)"


@query("spheroidal_table", ctes("vis") + f" SELECT nu, n, {r('CASE WHEN nu < 0.75 THEN ' + _spheroidal_sql(*S.SPHEROIDAL[0]) + ' ELSE ' + _spheroidal_sql(*S.SPHEROIDAL[1]) + ' END')} AS value FROM (SELECT abs(u) / 1000 AS nu, count(*) AS n FROM vis GROUP BY abs(u))")
def spheroidal_table(spark, sf):
    """The taper at every distance from the middle that samples have."""
    d = table(spark, sf, "vis").groupBy(F.abs("u").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return d.select((F.col("u") / 1000).alias("nu"), "n", rnd(S.spheroidal(F.col("u") / 1000)).alias("value"))


_R2 = "((x - 32) * (x - 32) + (y % 64 - 32) * (y % 64 - 32)) * 0.0001"


@query("phase_screen", ctes("image") + f" SELECT img, x, y, {r(f'value * cos({-2 * math.pi!r}::DOUBLE * 40.0 * (1 - sqrt(1 - {_R2})))')} AS re, {r(f'value * sin({-2 * math.pi!r}::DOUBLE * 40.0 * (1 - sqrt(1 - {_R2})))')} AS im FROM image")
def phase_screen(spark, sf):
    """All pixels turned by the screen of a w plane."""
    z = S.phase_screen(F.lit(40.0), (F.col("x") - 32) * 0.01, (F.col("y") % 64 - 32) * 0.01) * F.col("value")
    return table(spark, sf, "image").select("img", "x", "y", rnd(z.re).alias("re"), rnd(z.im).alias("im"))


_ION = f"({-2 * math.pi!r} * (u * 0.003 + v * 0.002) * ({C!r} / freq) * ({C!r} / freq))"


@query("ionospheric_term", ctes("vis") + f" SELECT chan, {r(f'sum(cos({_ION}))', 4)} AS re, {r(f'sum(sin({_ION}))', 4)} AS im FROM vis GROUP BY chan")
def ionospheric_term(spark, sf):
    z = Cx.phasor(S.ionospheric_phase("freq", "u", "v", F.lit(0.003), F.lit(0.002)))
    return table(spark, sf, "vis").groupBy("chan").agg(rnd(F.sum(z.re), 4).alias("re"), rnd(F.sum(z.im), 4).alias("im"))


_PIV = ", w AS (SELECT row_id, max(CASE WHEN pol = 0 THEN re END) AS xx, max(CASE WHEN pol = 1 THEN re END) AS xy, max(CASE WHEN pol = 2 THEN re END) AS yx, max(CASE WHEN pol = 3 THEN re END) AS yy, max(CASE WHEN pol = 1 THEN im END) AS xy_i, max(CASE WHEN pol = 2 THEN im END) AS yx_i FROM vis_pol GROUP BY row_id)"


def _pivoted(spark, sf):
    at = lambda p, c: F.max(F.when(F.col("pol") == p, F.col(c)))
    return table(spark, sf, "vis_pol").groupBy("row_id").agg(at(0, "re").alias("xx"), at(1, "re").alias("xy"), at(2, "re").alias("yx"), at(3, "re").alias("yy"), at(1, "im").alias("xy_i"), at(2, "im").alias("yx_i"))


@query("stokes_convert", ctes("ts", "vis_pol") + _PIV + f" SELECT row_id, {r('xx + yy')} AS i, {r('xx - yy')} AS q, {r('xy + yx')} AS u, {r('xy_i - yx_i')} AS v FROM w")
def stokes_convert(spark, sf):
    """Real part of Stokes parameters from linear products: V from the imaginary parts of the crossed ones."""
    w = _pivoted(spark, sf)
    return w.select("row_id", rnd(F.col("xx") + F.col("yy")).alias("i"), rnd(F.col("xx") - F.col("yy")).alias("q"), rnd(F.col("xy") + F.col("yx")).alias("u"), rnd(F.col("xy_i") - F.col("yx_i")).alias("v"))


_CA, _SA = repr(math.cos(0.7)), repr(math.sin(0.7))


@query("parallactic_rotation", ctes("ts", "vis_pol") + _PIV + f" SELECT row_id, {r(f'{_CA} * {_CA} * xx + {_CA} * {_SA} * (xy + yx) + {_SA} * {_SA} * yy')} AS xx, {r(f'{_SA} * {_SA} * xx - {_CA} * {_SA} * (xy + yx) + {_CA} * {_CA} * yy')} AS yy FROM w")
def parallactic_rotation(spark, sf):
    c, s = math.cos(0.7), math.sin(0.7)
    cross = F.col("xy") + F.col("yx")
    return _pivoted(spark, sf).select("row_id", rnd(c * c * F.col("xx") + c * s * cross + s * s * F.col("yy")).alias("xx"), rnd(s * s * F.col("xx") - c * s * cross + c * c * F.col("yy")).alias("yy"))


@query("leakage_effect", ctes("ts", "vis_pol") + _PIV + f" SELECT row_id, {r('xx + 0.05 * xy + 0.03 * yx + 0.05 * 0.03 * yy')} AS xx, {r('-0.02 * xx + xy - 0.02 * 0.03 * yx + 0.03 * yy')} AS xy FROM w")
def leakage_effect(spark, sf):
    """Mueller rows of real leakages: J1 (x) conj(J2) with d12, d21 off the diagonal."""
    d12a, d12b, d21b = 0.03, 0.05, 0.02
    w = _pivoted(spark, sf)
    x, y, z, t = (F.col(c) for c in ("xx", "xy", "yx", "yy"))
    return w.select("row_id", rnd(x + d12b * y + d12a * z + d12a * d12b * t).alias("xx"), rnd(-d21b * x + y - d21b * d12a * z + d12a * t).alias("xy"))


@query("gain_effect", ctes("ts", "vis_pol", "gains") + f", m AS (SELECT antenna, avg(g_re) AS gr, avg(g_im) AS gi FROM gains GROUP BY antenna) SELECT v.beam, v.pol, {r('sum(v.re * (a.gr * b.gr + a.gi * b.gi) - v.im * (a.gi * b.gr - a.gr * b.gi))', 2)} AS re, {r('sum(v.re * (a.gi * b.gr - a.gr * b.gi) + v.im * (a.gr * b.gr + a.gi * b.gi))', 2)} AS im FROM vis_pol v JOIN m a ON a.antenna = v.antenna1 JOIN m b ON b.antenna = v.antenna2 GROUP BY v.beam, v.pol")
def gain_effect(spark, sf):
    from ..operators.joins import both_antennas

    m = table(spark, sf, "gains").groupBy("antenna").agg(F.avg("g_re").alias("g_re"), F.avg("g_im").alias("g_im"))
    j = both_antennas(table(spark, sf, "vis_pol"), m, how="inner")
    z = K.corrupted(Cx.of("re", "im"), Cx.of("g1_re", "g1_im"), Cx.of("g2_re", "g2_im"))
    return j.groupBy("beam", "pol").agg(rnd(F.sum(z.re), 2).alias("re"), rnd(F.sum(z.im), 2).alias("im"))


@query("smearing_steps", ctes("vis") + f", k AS (SELECT i, CASE WHEN i IN (0, 4) THEN 0.125 ELSE 0.25 END AS wk FROM range(5) t(i)) SELECT scan, chan, {r(f'sum(wk * cos({2 * math.pi!r} * (freq + (i - 2) * 250000.0) * u / 50 / {C!r}))', 4)} AS re FROM vis, k GROUP BY scan, chan")
def smearing_steps(spark, sf):
    """Bandwidth smearing: a trapezium over frequency sub-steps, exploded and summed."""
    steps = F.explode(F.array(*[F.struct(F.lit((i - 2) * 250000.0).alias("df"), F.lit(0.125 if i in (0, 4) else 0.25).alias("wk")) for i in range(5)]))
    v = table(spark, sf, "vis").select("scan", "chan", "freq", "u", steps.alias("s"))
    z = S.delay_phasor(F.col("freq") + F.col("s.df"), F.col("u") / 50)
    return v.groupBy("scan", "chan").agg(rnd(F.sum(F.col("s.wk") * z.re), 4).alias("re"))


@query("sum_of_equations", ctes("vis") + f", u AS (SELECT pol, chan, re FROM vis WHERE scan < 6 UNION ALL SELECT pol, chan, re * 2 FROM vis WHERE scan >= 6) SELECT pol, chan, {r('sum(re)', 4)} AS re FROM u GROUP BY pol, chan")
def sum_of_equations(spark, sf):
    v = table(spark, sf, "vis")
    return v.where("scan < 6").select("pol", "chan", "re").unionByName(v.where("scan >= 6").select("pol", "chan", (F.col("re") * 2).alias("re"))).groupBy("pol", "chan").agg(rnd(F.sum("re"), 4).alias("re"))


@query("simulate_rows", "WITH t AS (SELECT CAST(k AS INTEGER) AS cycle, k * 10.0 AS ha FROM range(12) t(k)), a AS (SELECT CAST(s_suppkey % 36 AS INTEGER) AS antenna, avg(s_acctbal) AS x, avg(s_nationkey * 11.0) AS y, CAST(count(*) AS DOUBLE) AS z FROM supplier GROUP BY 1), f AS (SELECT CAST(k AS INTEGER) AS feed FROM range(3) t(k)) SELECT cycle, feed, a.antenna AS antenna1, b.antenna AS antenna2, " + r("sin(radians(ha)) * (b.x - a.x) + cos(radians(ha)) * (b.y - a.y)", 4) + " AS u, " + r("-sin(-0.5) * cos(radians(ha)) * (b.x - a.x) + sin(-0.5) * sin(radians(ha)) * (b.y - a.y) + cos(-0.5) * (b.z - a.z)", 4) + " AS v FROM t, f, a JOIN a b ON a.antenna < b.antenna")
def simulate_rows(spark, sf):
    """An array of 36 pads, placed by the suppliers of each, that tracks a source."""
    from ..operators.simulate import observed_rows

    s = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 36).cast("int").alias("antenna"))
    antennas = s.agg(F.avg("s_acctbal").alias("x"), F.avg(F.col("s_nationkey") * 11.0).alias("y"), F.count(F.lit(1)).cast("double").alias("z"))
    out = observed_rows(spark, antennas, n_cycles=12, degrees_per_cycle=10.0, n_feeds=3, declination=-0.5)
    return out.select("cycle", "feed", "antenna1", "antenna2", rnd("u", 4).alias("u"), rnd("v", 4).alias("v"))


#: The transform row by row, then column by column, as sums of 64 terms each.
_TURN = f"{2 * math.pi / 64!r} * ((g.gu - 32) * (t.i - 32))"
_FFT = f", rows AS (SELECT pol, t.i AS x, gv, sum(re * cos({_TURN}) - im * sin({_TURN})) AS re, sum(re * sin({_TURN}) + im * cos({_TURN})) AS im FROM g, range(64) t(i) GROUP BY pol, t.i, gv)"
_BACK = f"{2 * math.pi / 64!r} * ((gv - 32) * (t.i - 32))"


@query("fft_dirty_image", ctes("vis") + _BOX + _FFT + f" SELECT pol, CAST(x AS INTEGER) AS x, CAST(t.i AS INTEGER) AS y, {r(f'sum(re * cos({_BACK}) - im * sin({_BACK}))', 3)} AS value FROM rows, range(64) t(i) GROUP BY pol, x, t.i")
def fft_dirty_image(spark, sf):
    g = _box_grid(spark, sf)
    return G.images_of(g, ["pol"], 64).withColumn("value", rnd("value", 3))


def _planes(spark, sf):
    """Dirty images and point spread functions (pol, x, y, dirty, psf), from one transform of the box grid."""
    g = _box_grid(spark, sf)
    top = F.sum("weight").over(Window.partitionBy("pol"))  # a plane is bounded, and goes to one task anyway
    g = g.withColumn("_t", top).select("pol", "gu", "gv", *[(F.col(c) / F.col("_t")).alias(c) for c in ("re", "im", "psf_re", "psf_im")])
    return G.images_of(g, ["pol"], 64, {"dirty": ("re", "im"), "psf": ("psf_re", "psf_im")})


@query("clean_hogbom")
def clean_hogbom(spark, sf):
    def work(a):
        if a["psf"].max() <= 0 or a["psf"][32, 32] <= 0:
            return {"model": a["dirty"] * 0, "residual": a["dirty"], "restored": a["dirty"]}
        k = a["psf"][32, 32]
        model, residual, _ = D.hogbom(a["dirty"] / k, a["psf"] / k, D.Control(60, 0.1))
        return {"model": model, "residual": residual, "restored": D.restored(model, residual, (3.0, 2.0, 0.3))}

    out = D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["model", "residual", "restored"])
    return out.withColumns({c: rnd(c) for c in ("model", "residual", "restored")})


@query("precondition_robust")
def precondition_robust(spark, sf):
    def work(a):
        psf, dirty = D.robust_filter(np.where(a["psf"].max() > 0, a["psf"], 1.0), a["dirty"], 0.5)
        return {"psf": psf, "dirty": dirty}

    return D.per_plane(_planes(spark, sf), ["pol"], 64, work, ["dirty", "psf"], ["psf", "dirty"]).withColumns({c: rnd(c) for c in ("psf", "dirty")})


#: Known gains of antennas and channels, which solves have to find again.
_AMP, _ARG = "(1 + 0.01 * ({a} % 7) + 0.002 * {c})", "(0.05 * ({a} % 11) + 0.01 * {c})"
_MODEL = (1.0, 0.2)


def known_gain(antenna: str, other) -> Cx:
    a, c = F.col(antenna), F.col(other) if isinstance(other, str) else other
    return Cx.polar(1 + 0.01 * (a % 7) + 0.002 * c, 0.05 * (a % 11) + 0.01 * c)


def known_gain_sql(view: str, key: str, where: str) -> str:
    """Every antenna's known gain per key, its phase relative to the first antenna that has data there; 1 without data."""
    amp, arg = _AMP.format(a="g.antenna", c=f"g.{key}"), f"({_ARG.format(a='g.antenna', c=f'g.{key}')} - {_ARG.format(a='f.first', c=f'g.{key}')})"
    live = f"live AS (SELECT DISTINCT {key}, antenna FROM (SELECT {key}, antenna1 AS antenna FROM {view} WHERE {where} UNION ALL SELECT {key}, antenna2 FROM {view} WHERE {where}))"
    first = f"f AS (SELECT {key}, min(antenna) AS first FROM live GROUP BY {key}), g AS (SELECT f.{key}, CAST(k AS INTEGER) AS antenna FROM f, range(36) t(k))"
    pick = lambda x, y: f"CASE WHEN l.antenna IS NULL THEN {y} ELSE {r(x, 5)} END"
    return f", {live}, {first} SELECT g.{key}, g.antenna, {pick(f'{amp} * cos({arg})', '1.0')} AS g_re, {pick(f'{amp} * sin({arg})', '0.0')} AS g_im, l.antenna IS NOT NULL AS valid FROM g JOIN f USING ({key}) LEFT JOIN live l ON l.{key} = g.{key} AND l.antenna = g.antenna"


def _known_products(v, keys, other):
    """Products of a baseline for samples that the known gains make of the model."""
    model = Cx.of(*map(F.lit, _MODEL))
    z = model.conj() * (model * known_gain("antenna1", other) * known_gain("antenna2", other).conj())
    return v.groupBy(*keys, "antenna1", "antenna2").agg(F.sum(z.re).alias("vm_re"), F.sum(z.im).alias("vm_im"), F.sum(model.abs2()).alias("mm_re"))


@query("bandpass_solve", ctes("vis") + known_gain_sql("vis", "chan", "NOT flag AND antenna1 <> antenna2"))
def bandpass_solve(spark, sf):
    """Gains per channel from samples of a calibrator on the baselines of the table: the gains that made them."""
    v = table(spark, sf, "vis").where("NOT flag AND antenna1 <> antenna2")
    out = K.solved_gains(_known_products(v, ["chan"], "chan"), ["chan"], 36)
    return out.withColumns({"g_re": rnd("g_re", 5), "g_im": rnd("g_im", 5)})


_DELAY = "((antenna1 - antenna2) * 0.2 + 0.05 * (antenna1 % 3))"


@query("delay_solve", ctes("vis") + f", n AS (SELECT antenna1, antenna2, count(DISTINCT chan) AS n_chan FROM vis WHERE NOT flag AND antenna1 <> antenna2 GROUP BY antenna1, antenna2) SELECT antenna1, antenna2, CASE WHEN n_chan > 1 THEN {r(f'{_DELAY} * 1e9 / {C!r}', 3)} ELSE 0.0 END AS delay, n_chan FROM n")
def delay_solve(spark, sf):
    """Delays of baselines from the phase slopes over the channels that the table has: the delays that made them."""
    v = table(spark, sf, "vis").where("NOT flag AND antenna1 <> antenna2")
    z = S.delay_phasor("freq", F.expr(_DELAY))
    s = v.groupBy("antenna1", "antenna2", "chan").agg(F.avg(z.re).alias("re"), F.avg(z.im).alias("im"))
    return K.solved_delays(s, ["antenna1", "antenna2"], 1e6).withColumn("delay", rnd(F.col("delay") * 1e9, 3))


# ---- image planes -------------------------------------------------------------------------------------------------

_MOM = "sqrt(avg(value * value))"


@query("image_channel_stats", ctes("image") + f""", s AS (SELECT img, {_MOM} AS rms, stddev_pop(value) AS std, avg(value) AS mean, quantile_cont(value, 0.01) AS onepc, quantile_cont(value, 0.5) AS median, max(value) AS max, min(value) AS min FROM image GROUP BY img), m AS (SELECT i.img, quantile_cont(abs(i.value - s.median), 0.5) AS madfm FROM image i JOIN s USING (img) GROUP BY i.img)
SELECT img, """ + ", ".join(f"{r(c)} AS {c}" for c in ("rms", "std", "mean", "onepc", "median", "max", "min", "madfm")) + " FROM s JOIN m USING (img)")
def image_channel_stats(spark, sf):
    s = A.image_statistics(table(spark, sf, "image"), ["img"])
    return s.select("img", *[rnd(c).alias(c) for c in ("rms", "std", "mean", "onepc", "median", "max", "min", "madfm")])


@query("bad_channel_mask", ctes("image") + f""", s AS (SELECT img, quantile_cont(value, 0.01) AS onepc, quantile_cont(value, 0.5) AS median FROM image GROUP BY img), m AS (SELECT i.img, quantile_cont(abs(i.value - s.median), 0.5) AS madfm FROM image i JOIN s USING (img) GROUP BY i.img),
q AS (SELECT s.img, CASE WHEN madfm > 0 THEN onepc / madfm ELSE 0 END AS ratio FROM s JOIN m USING (img)), a AS (SELECT quantile_cont(ratio, 0.5) AS med FROM q), b AS (SELECT quantile_cont(abs(ratio - med), 0.5) AS mad FROM q, a)
SELECT img, {r('ratio')} AS ratio, {r('CASE WHEN mad > 0 THEN (ratio - med) / mad END', 4)} AS significance, coalesce(CASE WHEN mad > 0 THEN abs((ratio - med) / mad) > 2 END, FALSE) AS bad FROM q, a, b""")
def bad_channel_mask(spark, sf):
    b = A.bad_channels(A.image_statistics(table(spark, sf, "image"), ["img"]), 2.0)
    return b.select("img", rnd("ratio").alias("ratio"), rnd("significance", 4).alias("significance"), "bad")


@query("image_peak", ctes("image") + f" SELECT img, x, y, {r('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY abs(value * (1 + x / 64.0)) DESC, x, y) AS k FROM image) WHERE k = 1")
def image_peak(spark, sf):
    """The place comes from the weighted value, the value returned is unweighted."""
    p = A.peak(table(spark, sf, "image"), ["img"], F.abs(F.col("value") * (1 + F.col("x") / 64.0)), "x", "y")
    return p.select("img", "x", "y", rnd("value").alias("value"))


@query("peak_over_scales", ctes("image") + f" SELECT x, y, img AS scale, {r('value')} AS value FROM (SELECT *, row_number() OVER (ORDER BY abs(value) DESC, img, x, y) AS k FROM image) WHERE k = 1")
def peak_over_scales(spark, sf):
    p = A.peak(table(spark, sf, "image").withColumn("_all", F.lit(0)), ["_all"], F.abs("value"), "img", "x", "y")
    return p.select("x", "y", F.col("img").alias("scale"), rnd("value").alias("value"))


@query("component_choice", ctes("image") + f""", j AS (SELECT a.x, a.y % 50 AS y, sum(a.value) AS s0, sum(CASE WHEN a.img % 2 = 0 THEN a.value ELSE 0 END) AS s1 FROM image a GROUP BY a.x, a.y % 50),
c AS (SELECT x, y, (2 * s0 - s1) / 3 AS c0, (2 * s1 - s0) / 3 AS c1, s0, s1 FROM j), w AS (SELECT 'MAXBASE' AS criterion, x, y, abs(s0) / {math.sqrt(2)!r} AS worth FROM c UNION ALL SELECT 'MAXTERM0', x, y, abs(c0) * {math.sqrt(2)!r} FROM c UNION ALL SELECT 'MAXCHISQ', x, y, c0 * s0 + c1 * s1 FROM c)
SELECT criterion, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {r('worth')} AS worth FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY worth DESC, x, y) AS k FROM w) WHERE k = 1""")
def component_choice(spark, sf):
    """Best pixel by each criterion of a two-term clean whose terms couple by [[2, 1], [1, 2]]."""
    j = table(spark, sf, "image").groupBy("x", (F.col("y") % 50).alias("y")).agg(F.sum("value").alias("s0"), F.sum(F.when(F.col("img") % 2 == 0, F.col("value")).otherwise(0.0)).alias("s1"))
    c0, c1 = (2 * F.col("s0") - F.col("s1")) / 3, (2 * F.col("s1") - F.col("s0")) / 3
    worth = {"MAXBASE": F.abs("s0") / math.sqrt(2), "MAXTERM0": F.abs(c0) * math.sqrt(2), "MAXCHISQ": c0 * F.col("s0") + c1 * F.col("s1")}
    w = j.select("x", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("worth")) for k, v in worth.items()])).alias("w")).select("x", "y", "w.*")
    return A.peak(w, ["criterion"], F.col("worth"), "x", "y").select("criterion", "x", "y", rnd("worth").alias("worth"))


@query("quarter_extrema", ctes("image") + f" SELECT img, {r('max(value)')} AS max, {r('min(value)')} AS min, {r(_MOM)} AS rms FROM image WHERE x BETWEEN 16 AND 47 GROUP BY img")
def quarter_extrema(spark, sf):
    v = F.col("value")
    return table(spark, sf, "image").where("x BETWEEN 16 AND 47").groupBy("img").agg(rnd(F.max(v)).alias("max"), rnd(F.min(v)).alias("min"), rnd(F.sqrt(F.avg(v * v))).alias("rms"))


_W = ", w AS (SELECT x, y % 20 AS y, value, 1.0 + (img % 3) * exp(-(x - 32.0) * (x - 32.0) / 200) AS weight FROM image)"


def _weighted(spark, sf):
    return table(spark, sf, "image").select("x", (F.col("y") % 20).alias("y"), "value", (1.0 + (F.col("img") % 3) * F.exp(-(F.col("x") - 32.0) * (F.col("x") - 32.0) / 200)).alias("weight"))


@query("mosaic_weighted", ctes("image") + _W + f", s AS (SELECT x, y, sum(value * weight) / sum(weight) AS value, sum(weight) AS weight FROM w GROUP BY x, y) SELECT x, CAST(y AS INTEGER) AS y, {r('CASE WHEN weight >= 0.81 * (SELECT max(weight) FROM s) THEN value END')} AS value, {r('weight')} AS weight FROM s")
def mosaic_weighted(spark, sf):
    m = A.mosaic(_weighted(spark, sf), cutoff=0.9)
    return m.select("x", "y", rnd("value").alias("value"), rnd("weight").alias("weight"))


@query("sensitivity_image", ctes("image") + _W + f", s AS (SELECT x, y, sum(weight) AS weight FROM w GROUP BY x, y) SELECT x, CAST(y AS INTEGER) AS y, {r('CASE WHEN weight > 0.7 * (SELECT max(weight) FROM s) THEN 1 / sqrt(weight) ELSE 0 END')} AS sensitivity FROM s")
def sensitivity_image(spark, sf):
    s = A.sensitivity(_weighted(spark, sf).groupBy("x", "y").agg(F.sum("weight").alias("weight")), 0.7)
    return s.select("x", "y", rnd("sensitivity").alias("sensitivity"))


@query("normalised_image", ctes("image") + _W + f", s AS (SELECT x, y, sum(value) AS dirty, sum(weight) AS diag FROM w GROUP BY x, y), t AS (SELECT max(diag) AS top FROM s) SELECT x, CAST(y AS INTEGER) AS y, {r('CASE WHEN diag > 0.8 * top THEN dirty / diag ELSE 0 END')} AS value, {r('sqrt(diag / top)')} AS mask FROM s, t")
def normalised_image(spark, sf):
    s = _weighted(spark, sf).groupBy("x", "y").agg(F.sum("value").alias("dirty"), F.sum("weight").alias("diag"))
    s = s.join(s.agg(F.max("diag").alias("top")))
    return s.select("x", "y", rnd(F.when(F.col("diag") > 0.8 * F.col("top"), F.col("dirty") / F.col("diag")).otherwise(0.0)).alias("value"), rnd(F.sqrt(F.col("diag") / F.col("top"))).alias("mask"))


@query("weights_log", ctes("vis") + f" SELECT chan, {r('sum(1.0 / (sigma * sigma))', 4)} AS weight, count(*) AS n_rows FROM vis WHERE NOT flag GROUP BY chan")
def weights_log(spark, sf):
    return table(spark, sf, "vis").where("NOT flag").groupBy("chan").agg(rnd(F.sum(P.noise_weight("sigma")), 4).alias("weight"), F.count(F.lit(1)).alias("n_rows"))


@query("peak_residual", ctes("image") + f" SELECT {r('max(abs(value))')} AS peak, count(DISTINCT img) AS n_images FROM image")
def peak_residual(spark, sf):
    return table(spark, sf, "image").agg(rnd(F.max(F.abs("value"))).alias("peak"), F.countDistinct("img").alias("n_images"))


@query("cube_slice", ctes("image") + f" SELECT CAST(img - 2 AS INTEGER) AS chan, x, y, {r('value')} AS value FROM image WHERE img BETWEEN 2 AND 5 AND x BETWEEN 10 AND 20")
def cube_slice(spark, sf):
    return table(spark, sf, "image").where("img BETWEEN 2 AND 5 AND x BETWEEN 10 AND 20").select((F.col("img") - 2).alias("chan"), "x", "y", rnd("value").alias("value"))


@query("cube_merge", ctes("image") + f" SELECT CAST(img AS INTEGER) AS chan, x, y, {r('value')} AS value FROM image WHERE img IN (1, 4, 7)")
def cube_merge(spark, sf):
    i, out = table(spark, sf, "image"), None
    for c in (1, 4, 7):
        one = i.where(F.col("img") == c).select(F.lit(c).alias("chan"), "x", "y", rnd("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("nan_to_zero", ctes("image") + f" SELECT img, x, y, CASE WHEN x % 7 = 0 THEN 0.0 ELSE {r('value')} END AS value FROM image")
def nan_to_zero(spark, sf):
    broken = table(spark, sf, "image").withColumn("value", F.when(F.col("x") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return broken.select("img", "x", "y", rnd(F.nanvl("value", F.lit(0.0))).alias("value"))


@query("image_clip", ctes("image") + f" SELECT img, x, y, {r('CASE WHEN abs(x - 32) < 24 THEN value ELSE 0 END')} AS value FROM image")
def image_clip(spark, sf):
    return table(spark, sf, "image").select("img", "x", "y", rnd(F.when(F.abs(F.col("x") - 32) < 24, F.col("value")).otherwise(0.0)).alias("value"))


@query("scale_box", ctes("image") + f" SELECT img, x, y, {r('CASE WHEN x BETWEEN 12 AND 52 THEN value * 10 ELSE value END')} AS value FROM image")
def scale_box(spark, sf):
    return table(spark, sf, "image").select("img", "x", "y", rnd(F.when(F.col("x").between(12, 52), F.col("value") * 10).otherwise(F.col("value"))).alias("value"))


@query("facet_merge", ctes("image") + f" SELECT CAST(img * 16 + x - 24 AS INTEGER) AS x, y, {r('value')} AS value FROM image WHERE x BETWEEN 24 AND 39")
def facet_merge(spark, sf):
    """The middle of each facet, side by side."""
    return table(spark, sf, "image").where("x BETWEEN 24 AND 39").select((F.col("img") * 16 + F.col("x") - 24).alias("x"), "y", rnd("value").alias("value"))


@query("padded_plane", ctes("image") + f" SELECT img, CAST(x + 32 AS INTEGER) AS x, y, {r('value')} AS value FROM image")
def padded_plane(spark, sf):
    return table(spark, sf, "image").select("img", (F.col("x") + 32).alias("x"), "y", rnd("value").alias("value"))


@query("contour_pixels", ctes("image") + ", p AS (SELECT img, y, x AS px, value AS pv FROM (SELECT *, row_number() OVER (PARTITION BY img, y ORDER BY value DESC, x) AS k FROM image) WHERE k = 1), c AS (SELECT i.img, i.y, i.x, CASE WHEN i.x < p.px THEN 'left' ELSE 'right' END AS side, abs(i.x - p.px) AS d FROM image i JOIN p USING (img, y) WHERE i.x <> p.px AND i.value < 0.2 * p.pv) SELECT img, y, side, x FROM (SELECT *, row_number() OVER (PARTITION BY img, y, side ORDER BY d) AS k FROM c) WHERE k = 1")
def contour_pixels(spark, sf):
    """On each line, outwards both ways from the peak, the first pixel under a fifth of it."""
    i = table(spark, sf, "image")
    p = A.peak(i, ["img", "y"], F.col("value"), "x").select("img", "y", F.col("x").alias("px"), F.col("value").alias("pv"))
    c = i.join(p, ["img", "y"]).where("x <> px AND value < 0.2 * pv").withColumn("side", F.when(F.col("x") < F.col("px"), "left").otherwise("right"))
    return c.groupBy("img", "y", "side").agg(F.min_by("x", F.abs(F.col("x") - F.col("px"))).alias("x"))


@query("support_search", ctes("image") + ", t AS (SELECT img, max(abs(value)) AS top FROM image GROUP BY img) SELECT i.img, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM image i JOIN t USING (img) WHERE abs(value) >= 0.6 * top GROUP BY i.img")
def support_search(spark, sf):
    i = table(spark, sf, "image")
    t = i.groupBy("img").agg(F.max(F.abs("value")).alias("top"))
    return i.join(t, "img").where(F.abs("value") >= 0.6 * F.col("top")).groupBy("img").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


_PSF = ", k AS (SELECT CAST(a.d AS INTEGER) AS dx, CAST(b.d AS INTEGER) AS dy, exp(-(a.d * a.d + b.d * b.d) / 2.0) AS w FROM range(-2, 3) a(d), range(-2, 3) b(d))"


def _psf(spark):
    return G.local_rows(spark, [(i, j, math.exp(-(i * i + j * j) / 2.0)) for i in range(-2, 3) for j in range(-2, 3)], "dx int, dy int, w double")


@query("hogbom_one_iteration", ctes("image") + _PSF + f", p AS (SELECT img, x AS px, y AS py, value AS pv FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY abs(value) DESC, x, y) AS n FROM image) WHERE n = 1) SELECT i.img, i.x, i.y, {r('i.value - 0.1 * coalesce(k.w, 0) * p.pv')} AS residual, CASE WHEN i.x = p.px AND i.y = p.py THEN {r('0.1 * p.pv')} ELSE 0.0 END AS model FROM image i JOIN p USING (img) LEFT JOIN k ON k.dx = i.x - p.px AND k.dy = i.y - p.py")
def hogbom_one_iteration(spark, sf):
    i = table(spark, sf, "image")
    p = A.peak(i, ["img"], F.abs("value"), "x", "y").select("img", F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("pv"))
    j = i.join(p, "img").withColumns({"dx": F.col("x") - F.col("px"), "dy": F.col("y") - F.col("py")}).join(_psf(spark), ["dx", "dy"], "left")
    at = (F.col("dx") == 0) & (F.col("dy") == 0)
    return j.select("img", "x", "y", rnd(F.col("value") - 0.1 * F.coalesce("w", F.lit(0.0)) * F.col("pv")).alias("residual"), F.when(at, rnd(0.1 * F.col("pv"))).otherwise(0.0).alias("model"))


@query("restore_conv_direct", ctes("image") + _PSF + f" SELECT i.img, i.x + k.dx AS x, i.y + k.dy AS y, {r('sum(i.value * k.w)')} AS value FROM image i, k WHERE i.x + k.dx BETWEEN 0 AND 63 GROUP BY i.img, i.x + k.dx, i.y + k.dy")
def restore_conv_direct(spark, sf):
    """Convolution with a small kernel as a shifted fan-out and a sum."""
    j = table(spark, sf, "image").crossJoin(_psf(spark)).select("img", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("value") * F.col("w")).alias("v"))
    return j.where("x BETWEEN 0 AND 63").groupBy("img", "x", "y").agg(rnd(F.sum("v")).alias("value"))


@query("entropy_value", ctes("image") + f" SELECT img, {r('-sum(value * ln(value)) / sum(value) + ln(count(*))')} AS entropy, {r('0.5 * sum(abs(value / 0.5) + ln(1 + exp(-2 * abs(value / 0.5))) - ln(2))', 5)} AS emptiness FROM image WHERE value > 0 GROUP BY img")
def entropy_value(spark, sf):
    i = table(spark, sf, "image").where("value > 0")
    both = A.entropy(i, ["img"]).join(A.emptiness(i, ["img"], 0.0, 0.5), "img")
    return both.select("img", rnd("entropy").alias("entropy"), rnd("emptiness", 5).alias("emptiness"))


@query("strided_vectors", f"SELECT CAST(label AS INTEGER) AS img, CAST(vec_id AS INTEGER) AS y, CAST(p - 1 AS INTEGER) AS x, {r('CAST(e AS DOUBLE) + 2 * CAST(b AS DOUBLE)')} AS value FROM (SELECT label, vec_id, unnest(embedding) AS e, unnest(list_reverse(embedding)) AS b, generate_subscripts(embedding, 1) AS p FROM embeddings) WHERE p % 2 = 1")
def strided_vectors(spark, sf):
    """Scaled add of a vector and its reverse, every second element: array functions, no join."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("img"), F.col("vec_id").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    z = e.select("img", "y", F.posexplode(F.zip_with("e", F.reverse("e"), lambda p, q: p + 2 * q)).alias("x", "v"))
    return z.where("x % 2 = 0").select("img", "y", "x", rnd("v").alias("value"))


@query("robust_weights", ctes("vis") + _BOX + f", t AS (SELECT pol, max(weight) AS top FROM g GROUP BY pol) SELECT g.pol, gu, gv, {r('1.0 / (weight / (10.0 * top) + 1.0)')} AS filter FROM g JOIN t USING (pol)")
def robust_weights(spark, sf):
    """The pointwise filter of robust weighting over occupied cells, robustness 0.5."""
    g = _box_grid(spark, sf).select("pol", "gu", "gv", "weight")
    return g.join(g.groupBy("pol").agg(F.max("weight").alias("top")), "pol").select("pol", "gu", "gv", rnd(1.0 / (F.col("weight") / (10.0 * F.col("top")) + 1.0)).alias("filter"))


@query("beam_moments", ctes("image") + f" SELECT img, {r('sum(value * x) / sum(value)')} AS cx, {r('sqrt(sum(value * x * x) / sum(value) - (sum(value * x) / sum(value)) * (sum(value * x) / sum(value)))')} AS width FROM image WHERE value > 0.2 GROUP BY img")
def beam_moments(spark, sf):
    """The moments that start a beam fit."""
    i, v, x = table(spark, sf, "image").where("value > 0.2"), F.col("value"), F.col("x")
    mean = F.sum(v * x) / F.sum(v)
    return i.groupBy("img").agg(rnd(mean).alias("cx"), rnd(F.sqrt(F.sum(v * x * x) / F.sum(v) - mean * mean)).alias("width"))


@query("image_names", ctes("image") + " SELECT DISTINCT 'image.f' || img || '.facet.' || (img % 3) || '.' || (img % 2) || '.taylor.' || (img % 4) AS name, 'f' || img AS base, CAST(img % 3 AS INTEGER) AS facet_x, CAST(img % 2 AS INTEGER) AS facet_y, CAST(img % 4 AS INTEGER) AS term FROM image")
def image_names(spark, sf):
    from ..functions.names import parse_image_name

    s = lambda c: c.cast("string")
    i = F.col("img")
    n = table(spark, sf, "image").select("img").distinct().select(F.concat(F.lit("image.f"), s(i), F.lit(".facet."), s(i % 3), F.lit("."), s(i % 2), F.lit(".taylor."), s(i % 4)).alias("name"))
    return n.select("name", *parse_image_name("name"))


@query("stats_catalogue", ctes("image") + " SELECT printf('%5d %12.5f %12.5f', img, round(max(value), 5), round(min(value), 5)) AS line FROM image GROUP BY img")
def stats_catalogue(spark, sf):
    g = table(spark, sf, "image").groupBy("img").agg(F.round(F.max("value"), 5).alias("a"), F.round(F.min("value"), 5).alias("b"))
    return g.select(F.format_string("%5d %12.5f %12.5f", "img", "a", "b").alias("line"))
