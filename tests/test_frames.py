"""Velocity frames, calendar times and blocks that move with a frame, against geometry and plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions import frames
from fringeworks.operators import aggregates, images
from fringeworks.plans.catalogue import QUERIES
from fringeworks.sources import parset
from fringeworks.sources.driver_tables import table


def velocities(spark, frame, points, **site):
    """m/s for (seconds, ra, dec) points."""
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, t double, ra double, de double")
    return [r.v for r in df.select("i", frames.observer_velocity(frame, "t", "ra", "de", **site).alias("v")).orderBy("i").collect()]


def test_the_earth_moves_towards_longitude_270_at_the_march_equinox(spark):
    equinox, tilt = 60389.13 * 86400, math.radians(23.44)
    ahead, behind, sun, pole = velocities(spark, "BARY", [(equinox, 1.5 * math.pi, -tilt), (equinox, 0.5 * math.pi, tilt), (equinox, 0, 0), (equinox, 1.5 * math.pi, math.pi / 2 - tilt)])
    assert ahead == pytest.approx(29890, abs=100) and behind == pytest.approx(-ahead)
    assert abs(sun) < 700 and abs(pole) < 20  # the orbit is an ellipse, and flat


def test_orbital_velocity_is_the_slope_of_the_position(spark):
    def position(days):
        g, mean = math.radians(357.529 + 0.98560028 * days), 280.459 + (0.98564736 - 3.8246e-5) * days
        lam = math.radians(mean + 1.915 * math.sin(g) + 0.020 * math.sin(2 * g))
        r = -frames.AU * (1.00014 - 0.01671 * math.cos(g) - 0.00014 * math.cos(2 * g))
        return np.array([r * math.cos(lam), r * math.sin(lam) * math.cos(math.radians(23.439)), r * math.sin(lam) * math.sin(math.radians(23.439))])

    days = [0.0, 100.25, 4000.5, 9131.75]
    df = spark.createDataFrame([((d + frames.J2000) * 86400,) for d in days], "t double")
    got = [tuple(r)[1:] for r in sorted(df.select("t", *frames.orbital_velocity("t")).collect())]
    for d, v in zip(days, got, strict=True):
        assert np.allclose(v, (position(d + 0.01) - position(d - 0.01)) / (0.02 * 86400), atol=0.01)


def test_rotation_and_the_local_standard_of_rest(spark):
    t, equator = 5.2e9, 6378137.0
    place = math.radians(360 * (0.7790572732640 + 1.00273781191135448 * (t / 86400 - 51544.5)) % 360)
    rising, setting, above = ((t, place + h, 0.0) for h in (math.pi / 2, -math.pi / 2, 0.0))
    with_site, without = (velocities(spark, "BARY", [rising, setting, above], **kw) for kw in ({"x": equator}, {}))
    turn = [a - b for a, b in zip(with_site, without, strict=True)]
    assert turn == pytest.approx([465.1, -465.1, 0.0], abs=2)
    apex = (t, math.radians(270.9595417), math.radians(30.0046667))
    assert velocities(spark, "LSRK", [apex])[0] - velocities(spark, "BARY", [apex])[0] == pytest.approx(20000)
    assert velocities(spark, "TOPO", [apex]) == [0.0]
    with pytest.raises(ValueError):
        frames.observer_velocity("CMB", "t", "ra", "de")


def test_frequencies_there_and_back(spark):
    row = spark.range(1).select(
        frames.to_frame(F.lit(1.4e9), F.lit(3e4)).alias("a"), frames.from_frame(frames.to_frame(F.lit(1.4e9), F.lit(3e4)), F.lit(3e4)).alias("b"), frames.channel_shift(F.lit(1.4e9), F.lit(3e4), 18500.0).alias("c"), frames.channel_shift(F.lit(1.4e9), F.lit(3e4), -18500.0).alias("d")
    ).first()
    # who moves towards a source sees its lines too high
    assert row.a == pytest.approx(1.4e9 * (1 - 3e4 / 299792458 + (3e4 / 299792458) ** 2 / 2), abs=0.1) and row.b == pytest.approx(1.4e9, abs=1e-3)
    assert (row.c, row.d) == (-8, 8)


def test_moments_of_the_calendar():
    want = 60314 * 86400.0 + 10 * 3600 + 30 * 60
    for text in ("2024-01-05/10:30:00", "2024/01/05/10:30", "2024-01-05T10:30:00Z", "5jan2024/10:30:00", "05-Jan-2024/10:30:00.0", '"5 January 2024 10:30"', f"{60314 + 10.5 / 24}d"):
        assert parset.moment(text) == pytest.approx(want, abs=1e-4), text
    assert parset.moment("2024-01-05/10:30:00.25") == want + 0.25 and parset.moment("2024-01-05") == 60314 * 86400.0
    assert parset.moment("1858-11-17") == 0 and parset.moment(12.5) == 12.5
    for text in ("2024-02-30", "5xyz2024", "2024-01-05/24:00:00", "2024-01-05/10:60", "yesterday"):
        with pytest.raises(ValueError):
            parset.moment(text)
    with pytest.raises(ValueError):
        parset.selection({"timebegin": "2024-01-06", "timeend": "2024-01-05"})


def test_blocks_cover_every_channel_once():
    rng = np.random.default_rng(3)
    for n in (1, 5, 16, 64, 100, 257):
        for block in (0, 1, 7, 16, 300):
            for interleave in (False, True):
                for shift in ((), [5] * n, [-9] * n, list(np.sort(rng.integers(-20, 20, n)))):
                    got = images.shifted_blocks(n, block, interleave, shift)
                    assert [a for _, _, a, _ in got] == [0, *[z for *_, z in got[:-1]]] and got[-1][3] == n
                    assert all(0 <= f <= a < z <= e <= n for f, e, a, z in got)
    assert images.shifted_blocks(8, 4) == [(0, 4, 0, 4), (4, 8, 4, 8)]
    assert images.shifted_blocks(8, 4, shift=[1] * 8) == [(0, 5, 0, 5), (5, 8, 5, 8)]


def test_blocks_move_with_the_frame(spark):
    """Steps at the borders of shifted blocks go when the shift is told, and stay without it."""
    shift = [3] * 32 + [4] * 32
    levels = np.zeros(64)
    for a, z, level in ((0, 19, 5.0), (19, 36, -2.0), (36, 52, 8.0), (52, 64, 1.0)):
        levels[a:z] = level
    df = spark.createDataFrame([(0, 0, c, float(v)) for c, v in enumerate(levels)], "x int, y int, chan int, value double")
    left = {bool(s): np.array([r.value for r in images.image_continuum_subtracted(df, 0, block=16, shift=s).orderBy("chan").collect()]) for s in (shift, ())}
    assert np.abs(left[True]).max() < 1e-9 and np.abs(left[False]).max() > 1


def test_cube_in_a_frame_keeps_its_pixels(spark, sf_dir):
    got = QUERIES["image_contsub_frame"](spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "image").count() and len({(r.x, r.y, r.chan) for r in got}) == len(got)


@pytest.mark.parametrize("make", [lambda g: g.normal(size=30000), lambda g: np.exp(40 * g.normal(size=30000)), lambda g: np.round(g.normal(size=30000), 1), lambda g: np.concatenate([g.normal(size=29000), np.full(500, np.inf), np.full(500, -np.inf)]), lambda g: np.full(9000, 7.0)])
def test_quantiles_rank_only_parts_of_a_bracket(spark, make):
    values = make(np.random.default_rng(5))
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.777, "e": 0.99, "f": 1.0}
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: r for r in aggregates.quantiles(df, ["k"], F.col("v"), shares).collect()}
    for k in (0, 1):
        own = np.sort(values[k::2])
        for name, share in shares.items():
            at = share * (len(own) - 1)
            low, part = own[int(at)], at - int(at)
            want = low if part == 0 or low == own[min(int(at) + 1, len(own) - 1)] else low + part * (own[int(at) + 1] - low)
            assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)
