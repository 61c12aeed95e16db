"""Tasks of the command line on a small simulated dataset."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks import cli
from fringeworks.functions.scalar import C_LIGHT
from fringeworks.sources import store

N_ANT, N_CHAN = 6, 4


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A point source of 2 Jy seen by six antennas with gains 1 + a / 10."""
    at, rng, rows = tmp_path_factory.mktemp("cli"), np.random.default_rng(3), []
    xyz = rng.uniform(-60, 60, (N_ANT, 2))
    for t in range(5):
        turn = np.array([[math.cos(t / 4), -math.sin(t / 4)], [math.sin(t / 4), math.cos(t / 4)]])
        for a in range(N_ANT):
            for b in range(a + 1, N_ANT):
                u, v = turn @ (xyz[b] - xyz[a])
                for c in range(N_CHAN):
                    f = 1.0e9 + 1e7 * c
                    z = 2 * np.exp(2j * math.pi * f / C_LIGHT * (0.002 * u + 0.001 * v + (math.sqrt(1 - 5e-6) - 1) * 0.0)) * (1 + a / 10) * (1 + b / 10)
                    rows.append((0, 0, t * 10.0, a, b, 0, 0, c, f, "XX", float(u), float(v), 0.0, float(z.real), float(z.imag), 1.0, False))
    df = spark.createDataFrame(rows, "scan int, field_id int, time_s double, antenna1 int, antenna2 int, feed1 int, feed2 int, chan int, freq double, pol string, u double, v double, w double, re double, im double, sigma double, flag boolean")
    store.write_vis(df, str(at / "vis"))
    return str(at / "vis"), df, at


SOURCE = {"components.names": ["s"], "components.s.flux": 2, "components.s.l": 0.002, "components.s.m": 0.001}


def test_gains_of_a_known_source(spark, data):
    got = {(r.chan, r.antenna): r for r in cli.gains(spark, {"dataset": data[0], "nantennas": N_ANT, "minamplitude": 1.05, **SOURCE}).collect()}
    assert len(got) == N_ANT * N_CHAN
    for (_, a), r in got.items():
        assert (r.g_re, r.g_im) == pytest.approx((1 + a / 10, 0), abs=1e-4) and r.valid == (a > 0)


def test_a_model_leaves_what_gains_add(spark, data):
    r = cli.without_model(spark, {"dataset": data[0], **SOURCE}).where("antenna1 = 0 AND antenna2 = 1").collect()
    assert all(math.hypot(x.re, x.im) == pytest.approx(0.2, abs=1e-6) for x in r)


def test_images_and_cycles(spark, data):
    p = {"dataset": data[0], "cell": 10.0, "size": 64, "ncycles": 2, "niter": 60, "gain": 0.2}
    dirty = cli.imaged(spark, p).toPandas()
    top = dirty.loc[dirty["dirty"].idxmax()]
    # a direction cosine of 0.002 is 0.002 * 64 * 10 pixels from the middle
    assert abs(top["x"] - 32 - 1.28) <= 1.01 and abs(top["y"] - 32 - 0.64) <= 1.01
    out = cli.cleaned(spark, {**p, "gridder": "spheroidal", "support": 2, "oversample": 4}).toPandas()
    inner = out[out["x"].between(16, 47) & out["y"].between(16, 47)]
    assert len(out) == 64 * 64 and (out["model"] != 0).any() and set(out.loc[out["model"] != 0, "x"]) <= set(range(16, 48))
    assert np.abs(inner["residual"]).max() < 0.5 * float(top["dirty"]) / float(dirty["psf"].max())


def test_the_other_tasks_give_rows(spark, data, tmp_path):
    path, df, _ = data
    store.write_vis(df.withColumn("time_s", F.col("time_s") + 0.4), str(tmp_path / "two"))
    merged = cli.merged(spark, {"dataset": [path, str(tmp_path / "two")], "nchans": [N_CHAN, N_CHAN], "tolerance": 1.0})
    assert merged.count() == 2 * df.count() and merged.where("flag").count() == 0
    d = {(r.antenna1, r.antenna2): r.n_chan for r in cli.delays(spark, {"dataset": path, "chanwidth": "10MHz"}).collect()}
    assert len(d) == 15 and set(d.values()) == {N_CHAN}
    assert cli.spectra(spark, {"dataset": path, "nchan": N_CHAN, "padding": 2, "dofft": True}).count() == 15 * 2 * N_CHAN
    p = {"antennas.telescope": "t", "antennas.t.names": ["a", "b", "c"], "antennas.t.a": [0, 0, 0], "antennas.t.b": [1, 0, 0], "antennas.t.c": [0, 2, 0], "feeds.names": ["f"], "feeds.f": [0, 0], "ncycles": 4}
    assert cli.simulated(spark, p).count() == 3 * 4
    assert cli.errors(spark, {"nantennas": 3, "leakage": 0.1}).where("value LIKE 'gain.g11.%'").count() == 3
    px = spark.createDataFrame([("i", 0, c, 1, 1, float(c)) for c in range(5)], "image string, pol int, chan int, x int, y int, value double")
    store.write_cube(px, str(tmp_path / "cube"))
    assert {r.value for r in cli.plane(spark, {"image": str(tmp_path / "cube"), "channels": [1, 3]}).collect()} == {1.0, 2.0, 3.0}
    m = spark.createDataFrame([(0, 0, 1.0, 1.0, 0.0, 0.0), (1, 0, 3.0, 3.0, -1.0, 0.0)], "x int, y int, value double, weight double, shift_x double, shift_y double")
    m.write.parquet(str(tmp_path / "m"))
    assert [(r.x, r.y, r.value) for r in cli.mosaic(spark, {"image": str(tmp_path / "m")}).collect()] == [(0, 0, 2.5)]


def test_solves(spark, data):
    p = {"dataset": data[0], "nantennas": N_ANT, "nchan": N_CHAN, **SOURCE}
    for r in cli.bandpass(spark, {**p, "ncycles": 4, "niter": 10}).collect():
        assert r.valid and (r.g_re, r.g_im) == pytest.approx((1 + r.antenna / 10, 0), abs=1e-3)
    for r in cli.direction_gains(spark, p).collect():
        assert r.converged and r.direction == 0 and (r.g_re, r.g_im) == pytest.approx((1 + r.antenna / 10, 0), abs=1e-6)
    assert cli.antenna_delays(spark, {"dataset": data[0], "nchan": N_CHAN, "chanwidth": "10MHz"}).count() == N_ANT
    free = {"free": ["s.l", "s.m"], "components.s.l": 0.0021, "components.s.m": 0.0009, "components.s.flux": 3}
    got = {r.parameter: r.value for r in cli.component_fit(spark, {**p, **free}).collect()}
    assert got == {"l": pytest.approx(0.002, abs=1e-4), "m": pytest.approx(0.001, abs=1e-4)}


def test_imaging_with_terms_and_snapshots(spark, data):
    p = {"dataset": data[0], "cell": 10.0, "size": 64}
    t = cli.taylor_models(spark, {**p, "frequency": "1015MHz", "ncycles": 1, "niter": 10, "minflux": 0.05})
    assert t.count() == 64 * 64 and t.where("alpha IS NOT NULL").count() > 0
    top = max(cli.snapshots(spark, {**p, "tolerance": 0.5}).collect(), key=lambda r: r.value)
    assert abs(top.x - 33) <= 1 and abs(top.y - 33) <= 1
    c = cli.without_continuum(spark, {"dataset": data[0], "nchan": N_CHAN, "order": 0, "threshold": 0})
    assert c.count() == data[1].count() and abs(c.agg(F.avg("re")).first()[0]) < 1e-9


def test_main_runs_a_file_and_rejects_unknown_tasks(spark, data, tmp_path, monkeypatch):
    (tmp_path / "p.in").write_text(f'dataset = "{data[0]}"\nout = "{tmp_path}/out"\nrms = 0.1\n')
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert cli.main(["noise", str(tmp_path / "p.in")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == data[1].count()
    assert cli.main(["nonsense", "x"]) == 2
