"""Solves over the samples: the Krylov solver and direction-dependent gains against dense algebra on the same samples."""

import numpy as np
import pytest

from fringeworks.operators import ddcal as DD
from fringeworks.operators import lsqr as L
from fringeworks.plans import solvers as Q
from fringeworks.plans.catalogue import QUERIES
from fringeworks.sources.driver_tables import table


@pytest.mark.parametrize(("rows", "columns", "rank"), [(40, 12, 12), (12, 12, 12), (30, 10, 6), (8, 20, 8)])
def test_lsqr_is_least_squares(rows, columns, rank):
    rng = np.random.default_rng(rows + rank)
    a = rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, columns))
    b = rng.normal(size=rows)

    def product(w, c):
        u = a @ w + c * b
        return float(u @ u), a.T @ u

    x, passes = L.lsqr(product, columns, 4 * columns, 1e-13)
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=1e-10)[0], atol=1e-7) and passes <= 4 * columns + 1
    assert L.lsqr(lambda w, c: (float(np.sum((a @ w) ** 2)), a.T @ (a @ w)), columns)[0].tolist() == [0.0] * columns


def test_differences_stop_at_breaks():
    d = L.differences(7, 2, (4,))
    assert len(d) == 3 and not any((r[:4] != 0).any() and (r[4:] != 0).any() for r in d)
    assert np.allclose(d @ np.arange(7.0), 0) and np.allclose(L.differences(5, 1) @ np.ones(5), 0)


def products(rng, antennas, channels, noise, keys=(1,), missing=()):
    chan = np.arange(channels)
    g = np.array([(1 + 0.1 * np.sin(a + chan / 6)) * np.exp(1j * (0.3 * a + 0.02 * a * chan)) for a in range(antennas)])
    rows = []
    for k in keys:
        for i in range(antennas):
            for j in range(antennas):
                for c in range(channels):
                    if i < j and not {(i, c), (j, c)} & set(missing):
                        mm = float(rng.uniform(0.5, 2))
                        y = (g[i, c] * g[j, c].conj() + noise * (rng.normal() + 1j * rng.normal())) * mm
                        rows.append((k, i, j, c, float(y.real), float(y.imag), mm))
    return rows, g * np.exp(-1j * np.angle(g[:1]))


SCHEMA = "k int, antenna1 int, antenna2 int, chan int, vm_re double, vm_im double, mm_re double"


def dense(rows, antennas, channels, smoothing, order):
    """Gauss-Newton with the matrix written out."""
    g = np.ones((antennas, channels), complex)
    n = g.size
    d = np.kron(np.eye(antennas), L.differences(channels, order) * smoothing)
    free = [k for k in range(2 * n) if not n <= k < n + channels]  # the first antenna's gain is real
    for _ in range(30):
        a, y = np.zeros((2 * len(rows), 2 * n)), np.zeros(2 * len(rows))
        for r, (_, i, j, c, re, im, mm) in enumerate(rows):
            gi, gj, p, q = g[i, c], g[j, c], i * channels + c, j * channels + c
            for at, z in ((p, gj.conj()), (n + p, 1j * gj.conj()), (q, gi), (n + q, -1j * gi)):
                a[2 * r : 2 * r + 2, at] = mm**0.5 * z.real, mm**0.5 * z.imag
            rest = mm**0.5 * ((re + 1j * im) / mm - gi * gj.conj())
            y[2 * r : 2 * r + 2] = rest.real, rest.imag
        z = np.zeros_like(d)
        whole = np.concatenate([a, np.block([[d, z], [z, d]])])
        now = np.concatenate([y, -(d @ g.ravel()).real, -(d @ g.ravel()).imag])
        x = np.zeros(2 * n)
        x[free] = np.linalg.lstsq(whole[:, free], now, rcond=1e-9)[0]
        g = g + (x[:n] + 1j * x[n:]).reshape(g.shape)
    return g * np.exp(-1j * np.angle(g[:1]))


def solved(df, antennas, channels, rules, keys=("k",)):
    out = L.solved_bandpass(df, list(keys), antennas, channels, rules).toPandas()
    z = {}
    for key, one in out.groupby(list(keys)) if keys else [((), out)]:
        one = one.sort_values(["antenna", "chan"])
        z[key[0] if key else 0] = ((one.g_re + 1j * one.g_im).to_numpy().reshape(antennas, channels), one.valid.to_numpy().reshape(antennas, channels))
    return z


@pytest.mark.parametrize(("smoothing", "order"), [(0.0, 2), (1.0, 2)])
def test_bandpass_equals_a_dense_solve(spark, smoothing, order):
    rows, _ = products(np.random.default_rng(3), 4, 5, 0.05)
    rules = L.Rules(smoothing=smoothing, order=order, outer=9, inner=40, tolerance=1e-4)
    (got, valid), = solved(spark.createDataFrame(rows, SCHEMA).coalesce(2), 4, 5, rules).values()
    assert valid.all() and np.abs(got - dense(rows, 4, 5, smoothing, order)).max() < 1e-3


def test_keys_gaps_and_smoothing(spark):
    rng = np.random.default_rng(4)
    rows, truth = products(rng, 5, 8, 0.1, (1, 2), missing=((3, 4), (3, 5)))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    rules = L.Rules(outer=5, inner=12, tolerance=1e-2)
    plain, smooth = solved(df, 5, 8, rules), solved(df, 5, 8, L.Rules(smoothing=5.0, least_smoothing=0.5, outer=4, inner=20, tolerance=1e-2))
    for k in (1, 2):
        assert not plain[k][1][3, 4] and plain[k][0][3, 4] == 1 and plain[k][1].sum() == 38
        live = plain[k][1]
        bend = lambda z: np.abs(np.diff(z[[0, 1, 2, 4]], 2, axis=1)).mean()
        assert bend(smooth[k][0]) < bend(plain[k][0]) / 3
        assert np.abs(smooth[k][0] - truth)[live].mean() < np.abs(plain[k][0] - truth)[live].mean()
    assert rules.history[-1][0] < 1e-2
    assert L.solved_bandpass(df.limit(0), ["k"], 5, 8).count() == 0
    with pytest.raises(ValueError, match="unknowns"):
        L.solved_bandpass(df, ["k"], 5000, 5000)


def test_lsqr_queries(spark, sf_dir):
    rough = {}
    for name in ("lsqr_bandpass", "lsqr_bandpass_smooth"):
        got = QUERIES[name](spark, sf_dir)
        assert got.count() == Q.ANTENNAS * Q.CHANNELS
        rough[name] = L.roughness(got.where("valid"), ["antenna"]).toPandas()["rough"].mean()
    assert rough["lsqr_bandpass_smooth"] < rough["lsqr_bandpass"] / 4


def direction_rows(rng, antennas, gains, models, noise, times=6):
    out = []
    for i in range(antennas):
        for j in range(i + 1, antennas):
            for _ in range(times):
                m = models * np.exp(2j * np.pi * rng.uniform(size=len(models)))
                v = (gains[i] * gains[j].conj() * m).sum() + noise * (rng.normal() + 1j * rng.normal())
                out.append((i, j, m, v, rng.uniform(0.5, 2)))
    return out


def test_two_directions_are_told_apart(spark):
    """Amplitude and phase errors of a two-source model come back as gains of the two directions."""
    rng = np.random.default_rng(5)
    n = 8
    truth = (1 + 0.1 * rng.normal(size=(n, 2))) * np.exp(0.4j * rng.normal(size=(n, 2)))
    rows = direction_rows(rng, n, truth, np.array([2.0, 1.0]), 0.01)
    data = [(i, j, *(float(x) for z in m for x in (z.real, z.imag)), float(v.real), float(v.imag), float(w)) for i, j, m, v, w in rows]
    df = spark.createDataFrame(data, "antenna1 int, antenna2 int, a_re double, a_im double, b_re double, b_im double, re double, im double, w double")
    from pyspark.sql import functions as F

    from fringeworks.functions.complexcols import Cx

    sums = DD.products(df.withColumn("k", F.lit("x")), ["k"], Cx.of("re", "im"), [Cx.of("a_re", "a_im"), Cx.of("b_re", "b_im")], F.col("w"))
    out = DD.solved(sums, ["k"], n + 1, 2).toPandas().sort_values(["antenna", "direction"])
    got = (out.g_re + 1j * out.g_im).to_numpy().reshape(n + 1, 2)
    assert out.converged.all() and not out.valid.to_numpy().reshape(n + 1, 2)[n].any() and (got[n] == 1).all()
    assert np.abs(got[:n] - truth * np.exp(-1j * np.angle(truth[0]))).max() < 0.01

    # no change of any gain lowers the misfit of the samples themselves
    def misfit(g):
        return sum(w * abs(v - (g[i] * g[j].conj() * m).sum()) ** 2 for i, j, m, v, w in rows)

    least = misfit(got)
    for a, d, e in ((a, d, e) for a in range(n) for d in range(2) for e in (1e-3, -1e-3, 1e-3j, -1e-3j)):
        moved = got.copy()
        moved[a, d] += e
        assert misfit(moved) >= least - 1e-9
    r = sums.toPandas()
    i, j = r.antenna1.to_numpy(), r.antenna2.to_numpy()
    assert abs(DD.misfit(got, i, j, DD._complex(r.v, (2,)), DD._complex(r.m, (2, 2)), float(r.vv.sum())) - least) < 1e-6 * least + 1e-9


def test_dd_query(spark, sf_dir):
    out = QUERIES["dd_gain_solve"](spark, sf_dir).toPandas()
    assert len(out) == 2 * Q.ANTENNAS * 2 and out.converged.all()
    a, d = out.antenna.to_numpy(), out.direction.to_numpy()
    truth = lambda a, d: (1 + 0.05 * ((a + 3 * d) % 5)) * np.exp(1j * (0.1 * ((a * (d + 2)) % 6) - 0.2))
    want = truth(a, d) * np.exp(-1j * np.angle(truth(0, d)))
    got = (out.g_re + 1j * out.g_im).to_numpy()
    live = out.valid.to_numpy()
    assert live.mean() > 0.9 and np.abs(got - want)[live].mean() < 0.1
    assert table(spark, sf_dir, "vis").count() > 0
