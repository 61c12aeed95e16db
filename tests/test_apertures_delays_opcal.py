"""A-projection with a w stack, antenna delays and chunks of operation calibration, against loops over the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.functions.scalar import C_LIGHT
from fringeworks.operators import apertures as AP
from fringeworks.operators import delays as Y
from fringeworks.operators import illumination as L
from fringeworks.operators import opcal as OP
from fringeworks.plans import solvers as Q
from fringeworks.plans.catalogue import QUERIES


def test_epochs_follow_the_pointing(spark):
    rows = [("f", 1, float(t), 0.1 * (t // 40), 0.0, 0.0) for t in range(0, 100, 10)] + [("f", 2, float(t), 0.0, 0.0, 0.02 * t) for t in range(0, 60, 10)] + [("g", 1, 5.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "field_id string, feed int, time_s double, l double, m double, pa double")
    got = {(r.field_id, r.feed, r.time_s): r.epoch for r in AP.with_epochs(df, 0.01, 0.15, 35.0).collect()}
    assert got == {r[:3]: (1 + int(r[2]) // 40 if r[1] == 1 and r[0] == "f" else 1 + int(r[2]) // 10 if r[0] == "f" else 1) for r in rows}


def test_gridding_with_kernels_cell_by_cell(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(2)), int(rng.integers(2)), 1 + int(rng.integers(2)), int(rng.integers(2)), int(rng.integers(4)), int(rng.integers(4)), int(rng.integers(8, 24)), int(rng.integers(8, 24)), int(rng.integers(3)), *map(float, rng.normal(size=2))) for _ in range(150)]
    df = spark.createDataFrame(rows, "field_id int, feed int, epoch int, band int, fracu int, fracv int, iu int, iv int, wp int, re double, im double")
    df = df.withColumns({"l": 0.003 * F.col("feed") + 0.001 * F.col("epoch"), "m": 0.002 * F.col("field_id"), "pa": 0.2 * F.col("epoch"), "freq": 1.1e9 + 1e8 * F.col("band")})
    table = AP.kernels(df, Q.dish, 1.0, 2, 4)
    out = {(r.wp, r.gu, r.gv): (r.re, r.im, r.weight) for r in AP.gridded(df, table, Cx.of("re", "im").conj(), F.lit(2.0), ["wp"]).collect()}
    want, made = {}, {}
    for field, feed, epoch, band, fu, fv, iu, iv, wp, re, im in rows:
        if (field, feed, epoch, band) not in made:
            lam = C_LIGHT / (1.1e9 + 1e8 * band)
            p = L.offset(L.rotated(Q.dish(lam), 0.2 * epoch), 1.0, 0.003 * feed + 0.001 * epoch, 0.002 * field, lam)
            made[field, feed, epoch, band] = L.a_kernel_rows({0: p}, 2, 4)
        for _, u, v, du, dv, wr, wi in made[field, feed, epoch, band]:
            if (u, v) == (fu, fv):
                c = want.setdefault((wp, iu + du, iv + dv), np.zeros(3))
                z = 2 * (re - 1j * im) * (wr + 1j * wi)
                c += (z.real, z.imag, 2 * wr)
    assert out.keys() == want.keys() and all(np.allclose(out[k], want[k], atol=1e-9) for k in want)


def test_w_stack_puts_a_source_where_it_is(spark):
    n, cell, step = 64, 1.0, 4.0
    l, m = 12 / n, -9 / n  # noqa: E741
    rows = []
    for u, v in np.random.default_rng(7).integers(-20, 21, (2500, 2)):
        k = int(random.Random(f"{u} {v} {len(rows)}").randrange(5))
        phase = 2 * math.pi * (u * l + v * m + (k - 2) * step * (math.sqrt(1 - l * l - m * m) - 1))
        rows.append(("x", k, int(u) + 32, int(v) + 32, math.cos(phase), -math.sin(phase)))
    cells = spark.createDataFrame(rows, "pol string, wp int, gu int, gv int, re double, im double").groupBy("pol", "wp", "gu", "gv").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def peak(w_of):
        return max(AP.stacked_image(cells, "wp", w_of, ["pol"], n, cell).collect(), key=lambda r: r.value)

    best, flat = peak(lambda k: (k - 2) * step), peak(lambda k: 0.0)
    assert (best.x, best.y) == (44, 23) and best.value == pytest.approx(len(rows), rel=1e-9) and flat.value < 0.9 * best.value


@pytest.mark.parametrize("delay", [0.0, 3e-9, -4.2e-8, 3.1e-7, -4.4e-7])
def test_lag_peak_and_slope(delay):
    z = np.exp(2j * np.pi * 1e6 * np.arange(16) * delay)
    z[[3, 9]] = 0
    lag, quality = Y.lag_peak(z, 1e6)
    assert lag == pytest.approx(delay, abs=2e-9) and quality > 0.95
    assert lag + Y.slope(z * np.exp(-2j * np.pi * 1e6 * np.arange(16) * lag), 1e6) == pytest.approx(delay, abs=1e-13)
    assert Y.lag_peak(np.random.default_rng(8).normal(size=64) + 0j, 1e6)[1] < 0.6


def test_joint_delays(spark):
    true = {0: 0.0, 1: 5e-9, 2: -2e-8, 3: 1e-7, 7: 0.0, 8: 4e-9}
    rows = [("k", i, j, true[i] - true[j], 0.9) for i in true for j in true if i < j and (i < 5) == (j < 5)]
    rows += [("k", 1, 3, 9e-7, 0.95), ("k", 0, 1, 7e-7, 0.1)]
    df = spark.createDataFrame(rows, "b string, antenna1 int, antenna2 int, delay double, quality double")
    got = {r.antenna: r.delay for r in Y.antenna_delays(df, ["b"], 0, 0.5, [(1, 3)]).collect()}
    assert got[3] == pytest.approx(1e-7) and got[1] == pytest.approx(5e-9) and got[2] == pytest.approx(-2e-8) and got[0] == 0
    assert got[8] - got[7] == pytest.approx(4e-9) and got[8] + got[7] == pytest.approx(0, abs=1e-15)  # no path to the reference


def test_delays_under_noise(spark, sf_dir):
    rng = np.random.default_rng(11)
    true = rng.uniform(-1e-7, 1e-7, 8)
    rows = []
    for i in range(8):
        for j in range(i + 1, 8):
            for c in range(16):
                z = np.exp(2j * np.pi * 1e6 * c * (true[i] - true[j])) + 0.2 * (rng.normal() + 1j * rng.normal())
                rows.append((i, j, c, float(z.real), float(z.imag), bool(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, "antenna1 int, antenna2 int, chan int, re double, im double, flag boolean")
    b = Y.baseline_delays(Y.spectra(df, []), [], 16, 1e6)
    got = {r.antenna: r.delay for r in Y.antenna_delays(b, [], 2).collect()}
    assert all(got[a] == pytest.approx(true[a] - true[2], abs=2e-9) for a in range(8))
    assert QUERIES["antenna_delay_solve"](spark, sf_dir).count() > 1


def test_averaging_and_cutoff(spark):
    rows = [(0, 1, c, 1.0 + c, 0.0, False) for c in range(6)] + [(0, 1, 1, 900.0, 0.0, False), (0, 1, 2, 5.0, 0.0, True), (1, 1, 0, 1.0, 0.0, False)]
    df = spark.createDataFrame(rows, "antenna1 int, antenna2 int, chan int, re double, im double, flag boolean")
    assert {r.chan: (r.re, r.n) for r in Y.spectra(df, [], 2, 100.0).collect()} == {0: (1.5, 2), 1: (3.5, 2), 2: (5.5, 2)}


def loop_chunks(cycles, scans):
    out, before, chunk = {}, None, 0
    for c in sorted(set(cycles)):
        now = {}
        for beam, scan, first, last in scans:
            if first <= c <= last:
                now[beam] = min(now.get(beam, scan), scan)
        if now != before:
            chunk, before = chunk + 1, now
        out[c] = (chunk, now)
    return out


def test_chunks_equal_a_plain_loop(spark):
    rnd = random.Random(9)
    for _ in range(3):
        cycles = [rnd.randrange(300) for _ in range(200)]
        scans = [(rnd.randrange(4), s, first := rnd.randrange(300), first + rnd.randrange(60)) for s in range(20)]
        c = spark.createDataFrame([("d", x) for x in cycles], "dataset string, cycle long")
        s = spark.createDataFrame([("d", *x) for x in scans], "dataset string, beam int, scan int, first long, last long")
        found = OP.chunks(c, s, 40)
        assert {r.cycle: (r.chunk, r.beams) for r in found.collect()} == loop_chunks(cycles, scans)
        held = {}
        for chunk, now in loop_chunks(cycles, scans).values():
            for item in now.items():
                held.setdefault(item, set()).add(chunk)
        assert {(r.beam, r.scan): r.n_chunks for r in OP.torn(found).collect()} == {k: len(v) for k, v in held.items() if len(v) > 1}


def test_limited_scans(spark):
    s = spark.createDataFrame([("d", 0, 4, 10, 34), ("d", 1, 5, 0, 9)], "dataset string, beam int, scan int, first long, last long")
    assert sorted((r.beam, r.scan, r.first, r.last) for r in OP.limited(s, 10).collect()) == [(0, "4.0", 10, 19), (0, "4.1", 20, 29), (0, "4.2", 30, 34), (1, "5.0", 0, 9)]


def test_opcal_gains(spark):
    rnd = random.Random(10)
    gain = lambda a, b: (1 + 0.03 * ((a + b) % 4)) * complex(math.cos(p := 0.15 * ((a * 3 + b) % 5) - 0.3), math.sin(p))
    rows = []
    for cycle in range(40):
        for beam in (0, 1):
            for i in range(5):
                for j in range(i + 1, 5):
                    z = gain(i, beam) * gain(j, beam).conjugate() * 2 + complex(rnd.gauss(0, 0.05), rnd.gauss(0, 0.05))
                    rows.append(("d", cycle, beam, i, j, z.real, z.imag, 2.0, 0.0))
    df = spark.createDataFrame(rows, "dataset string, cycle long, beam int, antenna1 int, antenna2 int, re double, im double, m_re double, m_im double")
    scans = spark.createDataFrame([("d", 0, 1, 0, 19), ("d", 1, 2, 10, 30)], "dataset string, beam int, scan int, first long, last long")
    out = OP.solved(df, OP.chunks(df, scans, 16), F.lit(1.0), 6).collect()
    assert {(r.chunk, r.beam, r.scan) for r in out} == {(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 1, 2)}
    for r in out:
        if r.antenna == 5:
            assert not r.valid
        else:
            want = gain(r.antenna, r.beam) * gain(0, r.beam).conjugate() / abs(gain(0, r.beam))
            assert r.valid and abs(r.amplitude * complex(math.cos(r.phase), math.sin(r.phase)) - want) < 0.03


def test_w_stack_and_opcal_queries(spark, sf_dir):
    g = QUERIES["grid_a_w_stack"](spark, sf_dir)
    assert g.select("wp").distinct().count() > 1 and g.agg(F.sum("weight")).first()[0] > 0
    s = Q.aperture_samples(spark, sf_dir)
    assert s.select("epoch").distinct().count() > 1 and s.select("band").distinct().count() > 1
    assert QUERIES["opcal_gains"](spark, sf_dir).where("valid").count() > 0
