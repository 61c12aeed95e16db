"""Queries over image planes without a SQL twin, against planes gridded by hand and the definitions written out."""

import math

import numpy as np
import pytest

from fringeworks.operators import deconv as D
from fringeworks.operators import images
from fringeworks.plans.catalogue import QUERIES
from fringeworks.sources.driver_tables import table

N = 64


def inwards(x):
    """The nearest cell; the middle between two goes to the one nearer to 0."""
    return np.sign(x) * np.ceil(np.abs(x) - 0.5)


@pytest.fixture(scope="module")
def planes(spark, sf_dir):
    """pol -> (dirty, psf) of nearest-cell gridding, cell by cell, and a transform by matrices."""
    v = table(spark, sf_dir, "vis").where("NOT flag").toPandas()
    v["gu"], v["gv"] = (inwards(v[c].astype(float) / 50).astype(int) + 32 for c in "uv")
    v = v[(v.gu > 0) & (v.gu < N) & (v.gv > 0) & (v.gv < N)]
    turn = np.exp(2j * math.pi / N * np.outer(np.arange(N) - 32, np.arange(N) - 32))
    out = {}
    for pol, rows in v.groupby("pol"):
        grid, weight = np.zeros((N, N), complex), np.zeros((N, N))
        for r in rows.itertuples():
            w = 1 / float(r.sigma) ** 2
            grid[r.gu, r.gv] += w * (float(r.re) - 1j * float(r.im))
            weight[r.gu, r.gv] += w
        out[pol] = tuple((turn @ g @ turn).real / weight.sum() for g in (grid, weight.astype(complex)))
    return out


def arrays(spark, sf_dir, name, *columns):
    pdf = QUERIES[name](spark, sf_dir).toPandas()
    out = {}
    for pol, rows in pdf.groupby("pol"):
        assert len(rows) == N * N
        a = {c: np.zeros((N, N)) for c in columns}
        for c in columns:
            a[c][rows["x"], rows["y"]] = rows[c]
        out[pol] = a
    return out


def seen(f, image):
    return np.fft.fftshift(np.fft.ifft2(np.fft.fft2(np.fft.ifftshift(image)) * f)).real


def filtered(psf, dirty, f):
    p, d = seen(f, psf), seen(f, dirty)
    return p * psf.max() / p.max(), d * psf.max() / p.max()


def test_hogbom_step_by_step(spark, sf_dir, planes):
    got = arrays(spark, sf_dir, "clean_hogbom", "model", "residual", "restored")
    assert set(got) == set(planes)
    for pol, (dirty, psf) in planes.items():
        k = psf[32, 32]
        r, p, model = dirty / k, psf / k, np.zeros((N, N))
        for _ in range(60):
            i, j = np.unravel_index(np.abs(r).argmax(), r.shape)
            s = 0.1 * r[i, j]
            model[i, j] += s
            for x in range(N):
                for y in range(N):
                    a, b = x - i + 32, y - j + 32
                    if 0 <= a < N and 0 <= b < N:
                        r[x, y] -= s * p[a, b]
        assert np.abs(got[pol]["model"] - model).max() < 2e-4 and np.abs(got[pol]["residual"] - r).max() < 2e-4
        assert np.abs(got[pol]["restored"] - r).max() > 0


@pytest.mark.parametrize("name", ["precondition_robust", "precondition_wiener", "precondition_taper"])
def test_filters(spark, sf_dir, planes, name):
    got = arrays(spark, sf_dir, name, "psf", "dirty")
    f = np.fft.fftfreq(N)
    for pol, (dirty, psf) in planes.items():
        t = np.fft.fft2(np.fft.ifftshift(psf))
        filters = {
            "precondition_robust": 1 / (np.abs(t) / (10 * psf.max()) + 1),
            "precondition_wiener": np.conj(t / np.abs(t).max()) / (np.abs(t / np.abs(t).max()) ** 2 + 0.1),
            "precondition_taper": np.exp(-((math.pi * 3.0) ** 2) * (f[:, None] ** 2 + f[None] ** 2) / (4 * math.log(2))),
        }
        p, d = filtered(psf, dirty, filters[name])
        assert np.abs(got[pol]["psf"] - p).max() < 1e-4 and np.abs(got[pol]["dirty"] - d).max() < 1e-4


@pytest.mark.parametrize("name", ["clean_multi_scale", "deconvolve_fista", "deconvolve_entropy"])
def test_model_and_residual_make_up_the_dirty_image(spark, sf_dir, planes, name):
    got = arrays(spark, sf_dir, name, "model", "residual")
    for pol, (dirty, psf) in planes.items():
        dirty, psf = dirty / psf[32, 32], psf / psf[32, 32]
        a = got[pol]
        shown = np.fft.ifft2(np.fft.fft2(a["model"]) * np.fft.fft2(np.fft.ifftshift(psf))).real
        assert np.abs(dirty - shown - a["residual"]).max() < 5e-3
        assert (a["residual"] ** 2).sum() < (dirty**2).sum() and np.abs(a["model"]).sum() > 0


def test_multi_term_clean_lowers_the_residual(spark, sf_dir, planes):
    got = arrays(spark, sf_dir, "clean_multi_term", "model", "residual")
    for pol, (dirty, psf) in planes.items():
        assert (got[pol]["residual"] ** 2).sum() < ((dirty / psf[32, 32]) ** 2).sum()


def test_beam_fit_of_the_main_lobe(spark, sf_dir, planes):
    for r in QUERIES["psf_beam_fit"](spark, sf_dir).collect():
        psf = planes[r.pol][1]
        assert (r.major, r.minor) == pytest.approx(D.fit_beam(psf)[:2], abs=1e-3) and 0 < r.minor <= r.major and r.loss >= 1 - 1e-6


def test_regridding_turns_the_image(spark, sf_dir, planes):
    got = arrays(spark, sf_dir, "regridded_image", "linear", "nearest")
    c, s = math.cos(0.1), math.sin(0.1)
    for pol, (dirty, _) in planes.items():
        for x, y in ((32, 32), (20, 40), (45, 17), (10, 30)):
            u, v = c * (x - 32) - s * (y - 32) + 32, s * (x - 32) + c * (y - 32) + 32
            i, j = math.floor(u), math.floor(v)
            want = sum((u - i if a else 1 - u + i) * (v - j if b else 1 - v + j) * dirty[i + a, j + b] for a in (0, 1) for b in (0, 1))
            assert got[pol]["linear"][x, y] == pytest.approx(want, abs=1e-5)
            assert got[pol]["nearest"][x, y] == pytest.approx(dirty[math.floor(u + 0.5), math.floor(v + 0.5)], abs=1e-5)


def test_w_stack_is_the_sum_over_planes_turned_back(spark, sf_dir):
    v = table(spark, sf_dir, "vis").where("NOT flag").toPandas()
    gu, gv = (inwards(v[c].astype(float) / 50).astype(int) for c in "uv")
    p = (np.sign(v["w"]) * np.floor(np.abs(v["w"]) / 50 + 0.5)).astype(int)
    wt = 1 / v["sigma"].astype(float) ** 2
    use = (abs(gu) < 32) & (abs(gv) < 32) & (abs(p) <= 2)
    got = arrays(spark, sf_dir, "w_stack_image", "value")
    for pol in got:
        rows = use & (v["pol"] == pol)
        for x, y in ((32, 32), (5, 50), (60, 3)):
            l, m = (x - 32) / 3200, (y - 32) / 3200  # noqa: E741
            phase = 2 * math.pi * ((gu[rows] * (x - 32) + gv[rows] * (y - 32)) / N + p[rows] * 50 * (1 - math.sqrt(1 - l * l - m * m)))
            want = (wt[rows] * (v["re"].astype(float)[rows] - 1j * v["im"].astype(float)[rows]) * np.exp(1j * phase)).sum().real
            assert got[pol]["value"][x, y] == pytest.approx(want, abs=0.01)


def test_snapshot_planes_by_hand(spark, sf_dir):
    v = table(spark, sf_dir, "vis").toPandas()
    v["t"] = np.floor(v["time_s"] / 8640000) * 8640000
    got = {(r.scan, r.time_s): r for r in QUERIES["snapshot_planes"](spark, sf_dir).collect()}
    for scan, rows in v.groupby("scan"):
        fit, segment = None, -1
        for t, x in rows.groupby("t"):
            a, w = x[["u", "v"]].to_numpy(float), x["w"].to_numpy(float)
            if fit is None or math.sqrt(((w - a @ fit) ** 2).mean()) > 60.0:
                fit, segment = np.linalg.lstsq(a, w, rcond=None)[0], segment + 1
            r = got[scan, t]
            assert r.segment == segment and (r.a, r.b) == pytest.approx(tuple(fit), abs=1e-5)


def test_beamforming_weights_are_leading_eigenvectors(spark, sf_dir):
    v = table(spark, sf_dir, "vis_pol").where("NOT flag").toPandas()
    got = QUERIES["beamforming_weights"](spark, sf_dir).toPandas()
    for beam, rows in v.groupby("beam"):
        s, n = np.zeros((36, 36), complex), np.zeros((36, 36))
        z = rows["re"].to_numpy(float) + 1j * rows["im"].to_numpy(float)
        for a, b, x in ((rows["antenna1"], rows["antenna2"], z), (rows["antenna2"], rows["antenna1"], z.conj())):
            np.add.at(s, (a, b), x)
            np.add.at(n, (a, b), 1)
        c = np.where(n > 0, s / np.maximum(n, 1), 0)
        c = (c + c.conj().T) / 2
        g = got[got.beam == beam].sort_values("antenna")
        w = g["w_re"].to_numpy() + 1j * g["w_im"].to_numpy()
        top = np.linalg.eigvalsh(c)[-1]
        assert np.abs(c @ w - top * w).max() < 0.02 * abs(top) and np.linalg.norm(w) == pytest.approx(1, abs=1e-3)


def test_continuum_fits_leave_lines_and_take_polynomials(spark, sf_dir):
    cube = {}
    for r in table(spark, sf_dir, "image").collect():
        cube.setdefault((r.x, r.img), {})[r.y] = r.value
    whole = QUERIES["image_contsub"](spark, sf_dir).collect()
    blocks = QUERIES["image_contsub_blocks"](spark, sf_dir).collect()
    assert len(whole) == len(blocks) == sum(map(len, cube.values()))
    out = {}
    for r in whole:
        out.setdefault((r.x, r.y), {})[r.chan] = r.value
    for key in list(cube)[:40]:  # what was taken is a straight line over the channels
        chans = sorted(cube[key])
        gone = np.array([cube[key][c] - out[key][c] for c in chans])
        assert np.abs(gone - np.polyval(np.polyfit(chans, gone, 1), chans)).max() < 1e-5
    s = table(spark, sf_dir, "vis").where("NOT flag").groupBy("antenna1", "pol", "chan").avg("re").toPandas()
    got = QUERIES["vis_contsub_poly"](spark, sf_dir).toPandas().merge(s, on=["antenna1", "pol", "chan"])
    assert len(got) == len(s)
    for _, g in list(got.groupby(["antenna1", "pol"]))[:20]:
        gone = g["avg(re)"].astype(float) - g["residual"]
        if len(g) > 4:
            assert np.abs(gone - np.polyval(np.polyfit(g["chan"], gone, 2), g["chan"])).max() < 1e-5


def test_residual_falls_with_every_major_cycle(spark, sf_dir):
    rows = sorted(QUERIES["major_cycle"](spark, sf_dir).collect(), key=lambda r: (r.pol, r.cycle))
    for pol in {r.pol for r in rows}:
        own = [r for r in rows if r.pol == pol]
        assert [r.cycle for r in own] == [0, 1, 2, 3]
        assert own[0].peak > 1.5 and all(b.peak < a.peak for a, b in zip(own, own[1:], strict=False)) and own[-1].peak < 0.05
        assert own[-1].flux == pytest.approx(3.5, abs=0.3)


def test_smearing_keeps_the_centre_and_blurs_the_edge(spark, sf_dir, planes):
    got = arrays(spark, sf_dir, "smeared_image", "value")
    for pol, (dirty, _) in planes.items():
        a = got[pol]["value"]
        assert a.shape == dirty.shape and np.corrcoef(a.ravel(), dirty.ravel())[0, 1] > 0.5


def test_smearing_of_a_gaussian_is_the_mean_of_scaled_gaussians():
    """Against a sum over the analytic source: g(x / s) / s^2 for every scale s."""
    x, y = np.indices((64, 48)) - np.array([32, 24])[:, None, None]
    gaussian = lambda s: np.exp(-(((x / s - 17) ** 2 + (y / s + 9) ** 2) / (2 * 2.0**2))) / s**2
    for scales, width in ((21, 0.005), (5, 0.2), (1, 0.3)):
        want = np.mean([gaussian(1 + width * ((k + 0.5) / scales - 0.5)) for k in range(scales)], axis=0)
        assert np.allclose(images.radially_smeared(gaussian(1.0), scales, width), want, atol=1e-6)
    spot = np.zeros((64, 48))
    spot[32, 24] = 1.0
    assert np.allclose(images.radially_smeared(spot), spot)


def test_spectra_are_told_a_few_at_a_time(spark, monkeypatch):
    """A batch of many spectra leaves Python in parts; what is not finite comes back as null."""
    px = [(x, 0, c, None if (x, c) == (3, 2) else float(c * x + (c == 5))) for x in range(12) for c in range(8)]
    df, seen = spark.createDataFrame(px, "x int, y int, chan int, value double"), {}
    want = sorted(tuple(r) for r in images.image_continuum_subtracted(df, 1).where("value IS NOT NULL").collect())
    monkeypatch.setattr(images, "CELLS", 20, raising=False)
    monkeypatch.setattr(type(df), "mapInArrow", lambda cells, run, schema: seen.update(cells=cells, run=run))
    images.image_continuum_subtracted(df, 1)
    out = list(seen["run"](seen["cells"].toArrow().combine_chunks().to_batches()))
    assert len(out) >= 4 and max(b.num_rows for b in out) <= 24
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert [r[:3] for r in rows if r[3] is None] == [(3, 0, 2)]
    got = sorted(r for r in rows if r[3] is not None)
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(want) == 95
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
