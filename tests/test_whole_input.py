"""Queries without a SQL twin solve every scan, channel, antenna and baseline of their input."""

import math

import numpy as np
import pytest

from fringeworks.functions.scalar import C_LIGHT
from fringeworks.operators import calibrate as K
from fringeworks.plans import arrays
from fringeworks.plans.catalogue import QUERIES
from fringeworks.sources.driver_tables import table

GOOD = "NOT flag AND antenna1 <> antenna2"


@pytest.mark.parametrize(
    ("name", "view", "where", "keys"),
    [
        ("bandpass_solve", "vis", GOOD, ["chan"]),
        ("delay_solve", "vis", GOOD, ["antenna1", "antenna2"]),
        ("snapshot_planes", "vis", "true", ["scan"]),
        ("scan_calibration", "vis", GOOD + " AND feed1 = feed2", ["scan"]),
        ("beamforming_weights", "vis_pol", "NOT flag", ["beam"]),
    ],
)
def test_every_key_is_solved(name, view, where, keys, spark, sf_dir):
    got = {tuple(r) for r in QUERIES[name](spark, sf_dir).select(*keys).distinct().collect()}
    assert got == {tuple(r) for r in table(spark, sf_dir, view).where(where).select(*keys).distinct().collect()}


@pytest.mark.parametrize("name", ["bandpass_solve", "scan_calibration", "beamforming_weights"])
def test_every_antenna_is_solved(name, spark, sf_dir):
    assert {r.antenna for r in QUERIES[name](spark, sf_dir).select("antenna").distinct().collect()} == set(range(36))


def test_baseline_solve_takes_every_event(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(arrays.K, "baseline_offsets", lambda phases, *a: seen.append(phases.count()) or K_OFFSETS(phases, *a))
    got = {r.antenna: r.dx for r in QUERIES["baseline_solve"](spark, sf_dir).collect()}
    ts = table(spark, sf_dir, "ts")
    assert seen == [ts.count()]
    assert set(got) == {r.antenna for r in ts.select("antenna").distinct().collect()}
    assert all(abs(x - 0.01 * (a % 3)) < 1e-4 for a, x in got.items())


K_OFFSETS = K.baseline_offsets


def test_baseline_offsets_of_wrapped_phases(spark):
    """Phases turn several times along the hour angle; ha jumps over empty bins too."""
    rng = np.random.default_rng(8)
    k, want, rows = 2 * math.pi * 1.1e9 / C_LIGHT, {}, []
    for a in range(3):
        want[a] = rng.uniform(-1, 1, 3)
        ha = np.sort(np.concatenate([rng.uniform(-1.5, 0.4, 900), rng.uniform(0.42, 1.5, 500)]))
        p = k * (want[a][0] * math.cos(0.3) * np.cos(ha) - want[a][1] * math.cos(0.3) * np.sin(ha))
        rows += [(a, float(h), 0.3, float((x + math.pi) % (2 * math.pi) - math.pi)) for h, x in zip(ha, p, strict=True)]
    df = spark.createDataFrame(rows, "antenna int, ha double, dec double, phase double")
    for r in K.baseline_offsets(df, ["antenna"], 1.1e9).collect():
        assert np.allclose([r.dx, r.dy], want[r.antenna][:2], atol=1e-6)
