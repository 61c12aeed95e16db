"""Taylor-term imaging and snapshot imaging: known skies, cell by cell sums and transforms by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.operators import gridding as G
from fringeworks.operators import images as I  # noqa: E741
from fringeworks.operators import select as P
from fringeworks.operators import snapshot as N
from fringeworks.operators import taylor as T
from fringeworks.plans import solvers as Q

SAMPLES = "k string, plane int, fracu int, fracv int, iu int, iv int, re double, im double, freq double, w double"


def samples(rng, n=400, steps=1):
    return [("a" if rng.random() < 0.7 else "b", 0, int(rng.integers(steps)), int(rng.integers(steps)), int(rng.integers(8, 24)), int(rng.integers(8, 24)), *map(float, rng.normal(size=2)), float(rng.choice([1.2e9, 1.4e9, 1.7e9])), float(rng.uniform(0.5, 2))) for _ in range(n)]


@pytest.mark.parametrize("rows", [G.box_kernel(), G.spheroidal_kernel(1, 2)])
def test_equations_cell_by_cell(spark, rows):
    data = samples(np.random.default_rng(1), steps=1 if len(rows) == 1 else 2)
    terms, cells = 3, {}
    for k, plane, fu, fv, iu, iv, re, im, freq, w in data:
        x = freq / 1.4e9 - 1
        for p, u, v, du, dv, wr, wi in rows:
            if (p, u, v) == (plane, fu, fv):
                c = cells.setdefault((k, iu + du, iv + dv), np.zeros(9, complex))
                for t in range(terms):
                    c[t] += w * x**t * (re - 1j * im) * (wr + 1j * wi)
                for t in range(2 * terms - 1):
                    c[3 + t] += w * x**t * (wr + 1j * wi)
                c[8] += w
    df = spark.createDataFrame(data, SAMPLES)
    out = T.equations(df, G.kernel_table(spark, rows), Cx.of("re", "im").conj(), T.offset("freq", 1.4e9), F.col("w"), ["k"], terms).collect()
    assert len(out) == len(cells)
    for r in out:
        want = cells[r.k, r.gu, r.gv]
        got = [r[f"r{t}_re"] + 1j * r[f"r{t}_im"] for t in range(3)] + [r[f"p{t}_re"] + 1j * r[f"p{t}_im"] for t in range(5)] + [r.pcf]
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("rows", [G.box_kernel(), G.spheroidal_kernel(1, 2)])
def test_prediction_is_the_sum_of_terms(spark, rows):
    rng = np.random.default_rng(2)
    n, kernel = 32, G.kernel_table(spark, rows)
    df = spark.createDataFrame(samples(rng, 60, 1 if len(rows) == 1 else 2), SAMPLES).withColumn("id", F.monotonically_increasing_id()).persist()
    models = [(k, x, y, *(float(v) for v in rng.normal(size=2))) for k in "ab" for x, y in ((16, 16), (20, 9), (11, 25))]
    full = spark.createDataFrame(models, "k string, x int, y int, model0 double, model1 double")
    got = {r.id: (r.m_re, r.m_im) for r in T.predicted(df, full, kernel, T.offset("freq", 1.4e9), n, ["k"], 2).collect()}
    one = [{r.id: (r.re, r.im) for r in G.degridded(df, kernel, G.grids_of(full, ["k"], n, f"model{t}"), ["k"], ["id"]).collect()} for t in range(2)]
    assert len(got) == 60
    for r in df.collect():
        x = r.freq / 1.4e9 - 1
        want = [one[0][r.id][i] + x * one[1][r.id][i] for i in (0, 1)]
        assert got[r.id] == pytest.approx(want, abs=1e-9)


def test_spectra_are_found(spark, sf_dir):
    log, model = Q.taylor_model(spark, sf_dir)
    peaks = {}
    for r in log.collect():
        peaks.setdefault(r.pol, {})[r.cycle] = r.peak
    assert all(p[3] < 0.05 * p[0] and p[3] < p[1] for p in peaks.values())
    got = {(r.pol, r.x, r.y): (r.model0, r.alpha) for r in T.spectral_index(model, 0.2).where("alpha IS NOT NULL").collect()}
    assert set(got) == {(p, x, y) for p in peaks for x, y, _, _ in Q.TAYLOR_SKY}
    for p in peaks:
        for x, y, flux, alpha in Q.TAYLOR_SKY:
            assert got[p, x, y] == (pytest.approx(flux, abs=0.06), pytest.approx(alpha, abs=0.2))


def test_curvature(spark):
    df = spark.createDataFrame([(2.0, 2.0 * -0.7, 2.0 * (-0.7 * -1.7 / 2 + 0.1)), (0.01, 1.0, 1.0)], "model0 double, model1 double, model2 double")
    a, b = T.spectral_index(df, 0.1).collect()
    assert (a.alpha, a.beta) == (pytest.approx(-0.7), pytest.approx(0.1)) and b.alpha is None and b.beta is None


@pytest.mark.parametrize(("method", "error"), [("linear", 0.03), ("cubic", 2e-3), ("lanczos", 1e-2)])
def test_interpolation_of_a_smooth_image(method, error):
    x, y = np.indices((64, 64))
    f = lambda x, y: np.cos(0.3 * x) * np.sin(0.25 * y + 1)
    at = np.random.default_rng(3).uniform(8, 55, (2, 500))
    assert np.abs(I.regrid(f(x, y), *at, method) - f(*at)).max() < error
    assert np.allclose(I.regrid(f(x, y), x, y, method), f(x, y), atol=1e-12)
    assert I.regrid(f(x, y), np.array([-5.0, 80]), np.array([3.0, 3.0]), method).tolist() == [0, 0]


def test_planes_are_each_others_inverse():
    l, m = np.meshgrid(np.linspace(-0.4, 0.4, 9), np.linspace(-0.4, 0.4, 9))  # noqa: E741
    there = N.tilted(l, m, 0.5, -0.3)
    back = N.upright(*there, 0.5, -0.3)
    assert np.allclose(back, (l, m), atol=1e-9) and np.abs(np.array(there) - (l, m)).max() > 0.05
    assert np.isnan(N.tilted(np.array([0.9]), np.array([0.9]), 0.1, 0.1)[0]).all()
    image = np.zeros((64, 64))
    image[26:39, 26:39] = np.outer(np.hanning(13), np.hanning(13))
    again = N.reprojected(N.reprojected(image, 1.0, 0.4, 0.2, into=False), 1.0, 0.4, 0.2)
    assert np.abs(again - image).max() < 0.02


def test_a_source_off_axis_lands_on_one_pixel(spark):
    """Twelve planes: added as they are they smear the source, reprojected they agree, each by itself too."""
    rng = np.random.default_rng(4)
    l, m = Q.WIDE  # noqa: E741
    rows = []
    for k in range(6):
        a, b = 0.5 * math.sin(2 * k), 0.5 * math.cos(2 * k)
        for u, v in rng.uniform(-26, 26, (700, 2)):
            w = a * u + b * v
            phase = 2 * math.pi * (u * l + v * m + w * (math.sqrt(1 - l * l - m * m) - 1))
            rows.append(("x", float(k * 100), float(u), float(v), float(w), math.cos(phase), math.sin(phase), 0))
    df = spark.createDataFrame(rows, "pol string, time_s double, u double, v double, w double, re double, im double, plane int")
    s = N.segmented(df, ["pol"], 1e-6, 250.0)
    assert s.select("segment").distinct().count() == 6 and s.agg(F.max(F.abs("rest"))).first()[0] < 1e-9
    s = P.with_uv_cells(s, 1.0, 4, 64, wavelengths=True).where(P.on_grid("iu", "iv", 2, 64, 64)).persist()
    kernel = G.kernel_table(spark, G.spheroidal_kernel(2, 4))

    def image(df, method):
        out = np.zeros((64, 64))
        for r in N.snapshot_image(df, kernel, ["pol"], 64, 1.0, F.lit(1.0), method, G.spheroidal_correction).collect():
            out[r.x, r.y] = r.value
        return out[6:58, 6:58]

    where = lambda a: tuple(int(i) + 6 for i in np.unravel_index(a.argmax(), a.shape))
    true = (32 + round(l * 64), 32 + round(m * 64))
    for method in ("cubic", "lanczos"):
        together = image(s, method)
        assert where(together) == true and together.max() > 0.85
    assert image(s, None).max() < 0.4
    for segment in ("0.0", "1.0"):
        assert where(image(s.where(F.col("segment") == segment), "cubic")) == true


@pytest.mark.parametrize("kind", ["major", "taylor"])
def test_cycles_read_the_samples_once(kind, spark):
    """Samples are summed into bins before the first cycle; the bins' sums are the samples' own."""
    from fringeworks.operators import cycle as Y
    from fringeworks.operators import deconv as D

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    rows = [("XX", 0, 0, 0, 3 + i % 2, 4, float(i), float(-i), 1.0 + i % 3, 1.4e9 + 1e7 * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "pol string, plane int, fracu int, fracv int, iu int, iv int, re double, im double, sigma double, freq double")
    s, weight, control = df.withColumn("re", told("re")), 1 / (F.col("sigma") * F.col("sigma")), lambda: D.Control(5, 0.3)
    if kind == "major":
        Y.major_cycles(s, G.kernel_table(spark, G.box_kernel()), 8, ["pol"], weight, 1, control)[0].collect()
    else:
        T.cycles(s, G.kernel_table(spark, G.box_kernel()), 8, ["pol"], "freq", 1.4e9, weight, 2, 1, control)[0].collect()
    assert seen.value == len(rows)
    b = Y.binned(df, ["pol"], weight, ("freq",)).collect()
    for r in b:
        own = [x for x in rows if x[4] == r.iu and x[9] == r.freq]
        assert r._wt == pytest.approx(sum(1 / x[8] ** 2 for x in own)) and r._wt * r.re == pytest.approx(sum(x[6] / x[8] ** 2 for x in own))
    assert len(b) == len({(x[4], x[9]) for x in rows})
