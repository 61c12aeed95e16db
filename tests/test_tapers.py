"""Tapers tuned to the fitted beam, the normalised Wiener filter and wedges of feed legs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.operators import deconv as D
from fringeworks.operators import illumination as L
from fringeworks.operators import tapers as TP
from fringeworks.plans.catalogue import QUERIES


def lobe(n=128, seed=1):
    """A point-spread function of scattered cells, more of them near the middle."""
    rng = np.random.default_rng(seed)
    f = np.hypot(np.fft.fftfreq(n)[:, None], np.fft.fftfreq(n)[None])
    z = (rng.random((n, n)) < np.exp(-6 * f)) & (f < 0.4)
    psf = np.fft.fftshift(np.fft.ifft2(z | z[::-1, ::-1]).real)
    return psf / psf.max()


@pytest.mark.parametrize("beam", [(6.0, 6.0, 0.0), (9.0, 6.0, 0.7), (12.0, 7.0, -1.1)])
def test_the_fitted_beam_has_the_asked_width(beam):
    psf = lobe()
    out = TP.tuned_taper(psf, 3 * psf, beam)
    assert out.reached and D.fit_beam(out.psf)[:2] == pytest.approx(beam[:2], rel=0.01)
    if beam[0] != beam[1]:
        assert math.cos(D.fit_beam(out.psf)[2] - beam[2]) ** 2 > 0.999
    assert out.psf.max() == pytest.approx(1.0) and np.allclose(out.dirty, 3 * out.psf)
    once = TP.smoothed(psf, TP._possible(TP.covariance(beam) - TP.covariance(D.fit_beam(psf))))
    assert abs(D.fit_beam(once)[0] - beam[0]) >= abs(out.beam[0] - beam[0])  # widths of lobes do not just add up


def test_nothing_is_sharpened():
    psf = lobe()
    out = TP.tuned_taper(psf, psf, (0.5, 0.5, 0.0))
    assert not out.reached and np.allclose(out.psf, psf) and np.allclose(out.taper, 0, atol=1e-9)


def test_normalised_wiener_by_its_formula():
    psf, rng = lobe(64), np.random.default_rng(2)
    dirty = D.fft_convolve(rng.normal(size=psf.shape), psf)
    p, d = TP.normalised_wiener(psf, dirty, -0.5)
    z = np.fft.fft2(np.fft.ifftshift(psf))
    noise = 10 ** (2 * -0.5) * psf.max()
    own = np.fft.ifft2(np.fft.fft2(psf) * psf.max() * z.conj() / (np.abs(z) ** 2 + noise**2)).real
    assert p.max() == pytest.approx(psf.max()) and np.allclose(p, own * psf.max() / own.max())
    assert np.allclose(d, np.fft.ifft2(np.fft.fft2(dirty) * psf.max() * z.conj() / (np.abs(z) ** 2 + noise**2)).real * psf.max() / own.max())
    wide, narrow = (D.fit_beam(TP.normalised_wiener(psf, dirty, r)[0])[0] for r in (1.0, -1.5))
    assert narrow < wide


def test_wedges_turn_with_the_dish():
    p = L.disk(64, 1.0, 40.0, 4.0)
    w = L.wedged(p, 1.0, 8.0, 0.2)
    assert w[32 + 15, 32] == w[32, 32 - 15] == 0 and w[32 + 6, 32] == 1 and w[32 + 10, 32 + 10] == 1
    turned = L.wedged(p, 1.0, 8.0, 0.2, turn=math.pi / 4)
    assert turned[32 + 15, 32] == 1 and turned[32 + 10, 32 + 10] == 0
    lost = 1 - (w.real.sum() - (p * 0).real.sum()) / p.real.sum()
    x, y = np.indices(p.shape) - 32
    outer = (np.hypot(x, y) > 8) & (p == 1)
    assert lost == pytest.approx(outer.sum() / p.real.sum() * 4 * 0.4 / (2 * math.pi), abs=0.03)
    assert np.allclose(L.PATTERNS["wedged"](64, 1.0, 40.0, 4.0, 8.0, 0.2), L.wedged(L.tapered(64, 1.0, 40.0, 4.0), 1.0, 8.0, 0.2))


def test_queries(spark, sf_dir):
    for name in ("precondition_tuned_taper", "precondition_norm_wiener"):
        r = QUERIES[name](spark, sf_dir).agg(F.max("psf_out"), F.count("dirty_out")).first()
        assert r[0] > 0 and r[1] == 2 * 64 * 64
