"""Component fits, continuum with harmonics and proximal deconvolution over resolutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.operators import components as CO
from fringeworks.operators import continuum as CN
from fringeworks.operators import deconv as D
from fringeworks.plans import solvers as Q
from fringeworks.plans.catalogue import QUERIES


def test_derivatives_are_differences(spark):
    c = {"flux": 2.0, "l": 3e-4, "m": -2e-4, "alpha": -0.7, "f0": 1.2e9, "bmaj": 2e-4, "bmin": 1e-4, "bpa": 0.5}
    names = list(CO.POINT + CO.GAUSSIAN)
    df = spark.createDataFrame([(300.0, -120.0, 40.0, 1.1e9), (-15.0, 800.0, 0.0, 1.5e9)], "u double, v double, w double, freq double")

    def values(zs):
        return np.array([list(r) for r in df.select(*[x for z in zs for x in (z.re, z.im)]).collect()]).view(complex)

    exact = values(CO.derivatives(c, names).values())
    for i, n in enumerate(names):
        h = 1e-5 if n in ("flux", "alpha", "bpa") else 1e-9
        up, down = values([CO.visibility({**c, n: c[n] + h}), CO.visibility({**c, n: c[n] - h})]).T
        assert np.allclose(exact[:, i], (up - down) / (2 * h), rtol=1e-4, atol=1e-4 * np.abs(exact[:, i]).max()), n


def test_sources_are_recovered_without_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(*map(float, rng.uniform(-900, 900, 2)), float(rng.uniform(-50, 50)), float(rng.choice([1.1e9, 1.3e9]))) for _ in range(800)]
    df = spark.createDataFrame(rows, "u double, v double, w double, freq double")
    z = CO.visibility(Q.TRUE_SOURCES[0])
    for c in Q.TRUE_SOURCES[1:]:
        z = z + CO.visibility(c)
    fit = CO.fitted(df.withColumns({"re": z.re, "im": z.im}).coalesce(2).persist(), Q.FIRST_SOURCES, Q.FREE, F.lit(1.0))
    assert fit.misfits[-1] < 1e-12 * fit.misfits[0] and sorted(fit.misfits, reverse=True) == fit.misfits
    for i, n in Q.FREE:
        assert fit.components[i][n] == pytest.approx(Q.TRUE_SOURCES[i][n], rel=1e-4), (i, n)
    still = CO.fitted(df.withColumns({"re": z.re, "im": z.im}).limit(0), Q.FIRST_SOURCES, Q.FREE, F.lit(1.0))
    assert still.components == Q.FIRST_SOURCES


def test_component_query_is_right_within_its_errors(spark, sf_dir):
    for r in QUERIES["component_fit"](spark, sf_dir).collect():
        true = Q.TRUE_SOURCES[r.source][r.parameter] * (1 if r.parameter in ("flux", "bpa") else 1e6)
        assert 0 < r.error < 0.1 * abs(true) and abs(r.value - true) < 5 * r.error + 0.002, r


def test_terms_fit_the_channels():
    assert CN.affordable(2, 2, 100, 100) == (2, 2) and CN.affordable(2, 2, 34, 34) == (2, 1)
    assert CN.affordable(3, 1, 50, 100) == (2, 1) and CN.affordable(2, 2, 3, 3) == (0, 0)
    x = np.arange(64) / 64
    assert CN.basis(x, 2, 2).shape == (64, 7) and np.linalg.matrix_rank(CN.basis(x, 2, 2)) == 7


def test_ripple_and_slope_go_and_the_line_stays(spark):
    rng = np.random.default_rng(2)
    n = 128
    x = np.arange(n) / n
    continuum = 5 - 3 * x + 0.8 * np.sin(np.pi * x) + 0.5 * np.cos(2 * np.pi * x)
    line = np.where((np.arange(n) > 60) & (np.arange(n) < 66), 4.0, 0.0)
    y = continuum + line + 0.01 * rng.normal(size=n)
    rows = [("a", int(c), float(y[c]), float(-continuum[c]), bool(c in (10, 11))) for c in range(n)]
    rows[10] = ("a", 10, 500.0, 500.0, True)
    df = spark.createDataFrame(rows, "k string, chan int, re double, im double, flag boolean")
    out = CN.subtracted(df, ["k"], n, 1, 2, threshold=4.0).toPandas().sort_values("chan")
    off = (line == 0) & ~np.isin(np.arange(n), (10, 11))
    assert np.abs(out.re.to_numpy()[off]).max() < 0.06 and np.abs(out.re.to_numpy()[line > 0] - 4).max() < 0.1
    assert np.abs(out.im.to_numpy()[off]).max() < 1e-6
    plain = CN.subtracted(df, ["k"], n, 1, 0).toPandas().sort_values("chan")
    assert np.abs(plain.re.to_numpy()[off]).max() > 0.3
    blocks = CN.subtracted(df, ["k"], n, 2, 0, width=32, offset=16).toPandas()
    assert len(blocks) == n and np.abs(blocks.im.to_numpy()[off]).mean() < 0.05
    empty = CN.subtracted(df.withColumn("flag", F.lit(True)), ["k"], n, 1, 1).toPandas()
    assert empty.re.isna().all()


def test_harmonic_query(spark, sf_dir):
    out = QUERIES["vis_contsub_harmonic"](spark, sf_dir).toPandas()
    line = out.chan.isin((6, 7))
    assert (out.re[line].median() > 2) and out.re[~line].abs().median() < 0.2


def test_resolutions_are_whole_and_have_an_adjoint():
    rng = np.random.default_rng(3)
    a, widths = rng.normal(size=(32, 32)), [1.0, 2.0, 4.0]
    p = D.resolutions(a, widths)
    assert p.shape == (4, 32, 32) and np.allclose(D.from_resolutions(p), a)
    q = rng.normal(size=p.shape)
    assert (p * q).sum() == pytest.approx((a * D.resolutions_adjoint(q, widths)).sum())


def test_extended_source_over_resolutions():
    """In noise, shrinking resolutions leaves less of it than shrinking pixels does."""
    x, y = np.indices((64, 64)) - 32
    sky = np.exp(-(x**2 + y**2) / 60.0)
    f = np.hypot(np.fft.fftfreq(64)[:, None], np.fft.fftfreq(64)[None])
    rng = np.random.default_rng(4)
    taken = (f < 0.35) & (rng.random((64, 64)) < 0.7)
    taken[0, 0] = True
    psf = np.fft.fftshift(np.fft.ifft2(taken).real)
    dirty = D.fft_convolve(sky + 0.1 * rng.normal(size=sky.shape), psf / psf.max())
    error = {}
    for widths in ([], [1.0, 2.0, 4.0]):
        model, residual, level, cause = D.fista_redundant(dirty, psf / psf.max(), widths, D.Control(120, 0.2, fraction=0.05))
        assert cause == "CONVERGED" and np.abs(residual).max() <= 0.05 * np.abs(dirty).max() and level < 0.5 * np.abs(dirty).max()
        error[len(widths)] = ((model - sky) ** 2).sum()
    assert error[3] < error[0]
    point = np.zeros((64, 64))
    point[20, 40] = 1.0
    model, _, _, _ = D.fista_redundant(D.fft_convolve(point, psf / psf.max()), psf / psf.max(), [], D.Control(200, 0.2, fraction=0.01))
    assert np.unravel_index(model.argmax(), model.shape) == (20, 40)


def test_fista_query(spark, sf_dir):
    assert QUERIES["deconvolve_fista_redundant"](spark, sf_dir).agg(F.max(F.abs("model"))).first()[0] > 0
