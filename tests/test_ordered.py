"""Ordered operators, joins on time and streams: what happens at the borders of buckets and batches."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.operators import aggregates as A
from fringeworks.operators import cycle as Y
from fringeworks.operators import deconv as D
from fringeworks.operators import gridding as G
from fringeworks.operators import illumination as L
from fringeworks.operators import images as I  # noqa: E741
from fringeworks.operators import jones as Z
from fringeworks.operators import joins as J
from fringeworks.operators import ordered as O  # noqa: E741
from fringeworks.plans.catalogue import QUERIES, SQL
from fringeworks.sources import parset as C
from fringeworks.sources import store, text
from fringeworks.streaming import solutions as S


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    out = [(i, rnd.choice([1, 2, None]), round(rnd.uniform(0, 40), 1), rnd.choice([None, 1, 2, 3])) for i in range(300)]
    return out, spark.createDataFrame(out, "id int, k int, t double, x int")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


def test_carried_previous_and_running(rows):
    plain, df = rows
    bucket = F.floor(F.col("t") / 3)
    carried = {r.id: r.c for r in O.last_seen(df, ["k"], ["t", "id"], bucket, F.col("x"), "c").collect()}
    before = {r.id: None if r._prev is None else tuple(r._prev) for r in O.previous(df, ["k"], ["t", "id"], bucket, ["id", "x"]).collect()}
    total = {r.id: r.s for r in O.running_sum(df, ["k"], ["t", "id"], bucket, F.coalesce("x", F.lit(0)), "s").collect()}
    land = {r.id: r.island for r in O.islands(df, ["k"], ["t", "id"], bucket, [("t", 1.0), ("x", None)]).collect()}
    for k in (1, 2, None):
        last, prev, s, n = None, None, 0, 0
        for r in in_order(r for r in plain if r[1] == k):
            last = r[3] if r[3] is not None else last
            n += prev is None or r[2] - prev[2] > 1.0 or r[3] != prev[3]
            s += r[3] or 0
            assert (carried[r[0]], before[r[0]], total[r[0]], land[r[0]]) == (last, None if prev is None else (prev[0], prev[3]), s, n)
            prev = r


def test_asof_over_buckets_both_ways(spark):
    rnd = random.Random(7)
    left = [(i, rnd.choice("ab"), rnd.choice([None, *np.arange(0, 50, 0.5).tolist()])) for i in range(200)]
    right = [(rnd.choice("abc"), float(t), float(t) * 10) for t in sorted(rnd.sample(range(5, 45), 12))] + [("a", None, -1.0)]
    a, b = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, s double, x double")
    back = {r.id: r.x for r in J.asof(a, b, {"k": "k"}, "t", "s", ["x"], bucket=4.0).collect()}
    ahead = {r.id: r.x for r in J.asof(a, b, {"k": "k"}, "t", "s", ["x"], forward=True, bucket=4.0).collect()}
    for i, k, t in left:
        own = [(s, x) for q, s, x in right if q == k and s is not None and t is not None]
        assert back[i] == max(((s, x) for s, x in own if s <= t), default=(0, None))[1]
        assert ahead[i] == min(((s, x) for s, x in own if s >= t), default=(0, None))[1]


def test_first_interval_over_buckets(spark):
    rnd = random.Random(8)
    iv = [(n, rnd.choice([1, 2]), a, a + rnd.choice([0.0, 0.5, 3.0, 11.0])) for n, a in enumerate(rnd.choice(np.arange(0, 30, 0.5).tolist()) for _ in range(25))]
    pts = [(i, rnd.choice([1, 2, 3]), float(t)) for i, t in enumerate(np.arange(-1, 45, 0.25))] + [(999, 1, None)]
    got = {r.id: r.n for r in J.first_interval(spark.createDataFrame(pts, "id int, k int, t double"), spark.createDataFrame(iv, "n int, k int, a double, b double"), "t", ["k"], "a", "b", "n", bucket=4.0).collect()}
    assert got == {i: min((n for n, q, a, b in iv if q == k and t is not None and a <= t <= b), default=None) for i, k, t in pts}
    assert "NestedLoop" not in J.first_interval(spark.range(5).withColumn("t", F.col("id").cast("double")), spark.createDataFrame(iv, "n int, k int, a double, b double"), "t", [], "a", "b", "n")._jdf.queryExecution().executedPlan().toString()


def test_times_across_a_second_merge(spark):
    one = spark.createDataFrame([(0.9, 1, 0, 1.0, 0.0, False), (86399.8, 1, 0, 5.0, 0.0, False), (50.0, 2, 0, 7.0, 0.0, False)], "time_s double, k int, chan int, re double, im double, flag boolean")
    two = spark.createDataFrame([(1.1, 1, 0, 2.0, 0.0, False), (86400.1, 1, 0, 6.0, 0.0, False), (52.5, 2, 0, 8.0, 0.0, False)], one.schema)
    got = sorted((r.time_s, r.k, r.chan, r.re, r.flag) for r in J.merge_channels([one, two], [1, 1], ["k"]).collect())
    assert got == [(0.9, 1, 0, 1.0, False), (0.9, 1, 1, 2.0, False), (50.0, 2, 0, 7.0, False), (50.0, 2, 1, 0.0, True), (52.5, 2, 0, 0.0, True), (52.5, 2, 1, 8.0, False), (86399.8, 1, 0, 5.0, False), (86399.8, 1, 1, 6.0, False)]


def test_quantiles_are_exact_for_few_and_many(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 37, 9000):
        x = np.round(rng.normal(size=n), 3)
        df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 1.0), (1, None), (1, float("nan"))], "k int, v double")
        q = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0, "f": 0.0}
        r = A.quantiles(df, ["k"], F.col("v"), q).where("k = 1").first()
        assert [r[c] for c in q] == pytest.approx([np.quantile(x, s) for s in q.values()], abs=1e-12), n


def test_late_rows_and_batches_give_the_scans_of_the_whole(spark, tmp_path):
    """Files out of order within the watermark; the last scan of each beam is open and told."""
    rng = random.Random(3)
    events = sorted((rng.randint(0, 400_000), rng.randrange(70)) for _ in range(400))
    rows = [(i, 1_600_000_000 + t, u) for i, (t, u) in enumerate(events)]
    parts = [rows[:150], rows[160:300], rows[150:160] + rows[300:]]
    schema = "event_id long, s long, user_id long"
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 100, 1_700_000_000 + n * 100))
    stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in S.latest_scans(S.drained(S.scan_sessions(stream, 1800.0, "30 hours"), "update")).collect())
    want = []
    for beam in range(7):
        scan = None
        for _, t, u in sorted((r for r in rows if r[2] % 7 == beam), key=lambda r: (r[1], r[0])):
            if scan and (t - scan[2] > 1800 or u % 36 % 3 != scan[4]):
                want.append(tuple(scan[:4]))
                scan = None
            scan = [beam, scan[1] if scan else float(t), float(t), scan[3] + 1 if scan else 1, u % 36 % 3]
        want.append(tuple(scan[:4]))
    assert got == sorted(want)


def test_sparse_cube_keeps_its_places(spark, tmp_path):
    px = [("i", 0, 3, 2, 1, 5.0), ("i", 0, 3, 0, 4, 6.0), ("i", 1, 4, 1, 0, 7.0)]
    store.write_cube(spark.createDataFrame(px, "image string, pol int, chan int, x int, y int, value double"), str(tmp_path / "c"))
    assert sorted((r.image, r.pol, r.chan, r.x, r.y, r.value) for r in store.read_cube(spark, str(tmp_path / "c")).collect()) == sorted(px)


def test_noise_goes_through_the_inverse_matrix(spark):
    rng = np.random.default_rng(4)
    j1, j2 = (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)) for _ in range(2))
    v = rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))
    seen, sigma = j1 @ v @ j2.conj().T, np.array([0.5, 1.0, 2.0, 3.0])
    lit = lambda z: Cx(F.lit(float(z.real)), F.lit(float(z.imag)))
    m = lambda a: tuple(map(lit, a.ravel()))
    df = spark.createDataFrame([(False, True), (True, True), (False, False)], "bad boolean, valid boolean")
    out = Z.applied(df, m(seen), m(j1), m(j2), F.col("valid"), F.col("bad"), [F.lit(float(s)) for s in sigma]).collect()
    mueller = np.linalg.inv(np.kron(j1, j2.conj()))
    want = np.sqrt((np.abs(mueller) ** 2) @ sigma**2)
    assert [out[0][f"v{p}_re"] + 1j * out[0][f"v{p}_im"] for p in range(4)] == pytest.approx(v.ravel().tolist())
    assert [out[0][f"sigma{p}"] for p in range(4)] == pytest.approx(want.tolist()) and not out[0].flag
    assert all(r.flag and r.v0_re == 0 and r.sigma1 is None for r in out[1:])
    with pytest.raises(Exception, match="no valid calibration"):
        Z.applied(df, m(seen), m(j1), m(j2), F.col("valid"), F.col("bad"), allow_flag=False).collect()


def test_kernels_of_both_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("p" if i % 3 else None, int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(x), int(y), *map(float, rng.normal(size=3))) for i, (x, y) in enumerate(rng.integers(-2000, 2000, (400, 2)))]
    df = spark.createDataFrame(rows, "pol string, plane int, fracu int, fracv int, iu int, iv int, re double, im double, wt double")
    kernel = G.w_kernels(50.0, 3, 100.0, support=2, oversample=4, size=16)
    result = lambda: {(r.pol, r.gu, r.gv): (r.re, r.im, r.psf_re, r.psf_im, r.weight) for r in G.gridded(df, G.kernel_table(spark, kernel), Cx.of("re", "im"), F.col("wt"), ["pol"]).collect()}
    dense = result()
    monkeypatch.setattr(G, "KERNEL_ROWS", 0)
    joined = result()
    assert set(dense) == set(joined) and all(dense[k] == pytest.approx(joined[k], abs=1e-12) for k in dense)


def test_a_kernel_is_the_aw_kernel_at_w_0():
    p = {0: L.tapered(16, 1.0, 8.0, 1.0)}
    a, aw = L.a_kernel_rows(p, 2, 2), L.aw_kernel_rows(p, [0.0, 40.0], 0.1, 2, 2)
    assert [r[1:] for r in a] == [r[1:] for r in aw if r[0] == 0] and any(abs(r[6]) > 1e-6 for r in aw if r[0] == 1)
    assert np.array_equal(L.rotated(p[0], 0.0), p[0]) and not np.array_equal(L.rotated(L.disk(16, 1.0, 8.0) * np.arange(16)[:, None], math.pi / 2), L.disk(16, 1.0, 8.0) * np.arange(16)[:, None])


def test_deep_phase_goes_on_where_components_are():
    rng = np.random.default_rng(1)
    dirty, psf = np.zeros((16, 16)), np.zeros((16, 16))
    psf[8, 8], dirty[4, 4], dirty[10, 3] = 1.0, 1.0, 0.2
    dirty += rng.normal(size=dirty.shape) * 1e-3
    model, residual, cause = D.hogbom(dirty, psf, D.Control(500, 0.2, absolute=0.3, deep=0.01))
    assert cause == "CONVERGED" and abs(residual[4, 4]) <= 0.01 and model[10, 3] == 0 and residual[10, 3] > 0.19


def test_wiener_by_robustness_and_taper():
    x = np.hypot(*(np.indices((16, 16)) - 8))
    psf = np.exp(-(x**2) / 4)
    same = [D.wiener_filter(psf, psf, noise_power=0.01), D.wiener_filter(psf, psf, robustness=-0.5)]
    assert np.allclose(same[0][0], same[1][0]) and not np.allclose(D.wiener_filter(psf, psf, 0.01, taper=4.0)[0], same[0][0])
    with pytest.raises(ValueError, match="either"):
        D.wiener_filter(psf, psf)


def test_definitions_and_bad_ones():
    p = C.parse('feeds.names = [f0, f1]\nfeeds.spacing = 1deg\nfeeds.f0 = [1, 0]\nfeeds.f1 = [0, -0.5]\nspws.names = [c]\nspws.c = [16, 1.3GHz, -1MHz, "XX YY"]\nsources.names=[a]\nsources.a.direction=[12h30m, -45.00.00, J2000]')
    assert [(f["x"], f["y"]) for f in C.feeds(p)] == [(math.radians(1), 0), (0, -0.5 * math.radians(1))]
    assert C.spectral_windows(p) == [{"spw": 0, "name": "c", "n_chan": 16, "first": 1.3e9, "step": -1e6, "pol": "XX YY"}]
    assert C.sources(p)[0]["name"] == "a"
    for bad in ("antennas.telescope = t", "antennas.telescope = t\nantennas.t.names = [a]\nantennas.t.mount = odd", "antennas.telescope = t\nantennas.t.names = [a]\nantennas.t.a = [1,2,3]\nantennas.t.diameter = 0m"):
        with pytest.raises(ValueError):
            C.antennas(C.parse(bad))
    with pytest.raises(ValueError):
        C.feeds({})


def test_statistics_beside_an_image(spark, tmp_path):
    s = spark.createDataFrame([(0, 1.4e9, *[0.001] * 8)], "chan int, freq double, mean double, std double, median double, madfm double, onepc double, min double, max double, rms double")
    text.write_statistics_table(s, str(tmp_path / "img"))
    r = spark.read.parquet(str(tmp_path / "img/_ImgStats"))
    assert r.first()["1%ile"] == pytest.approx(1.0) and json.loads(r.schema["Frequency"].json())["metadata"] == {"unit": "MHz"}


def test_stokes_and_hooks(spark):
    with pytest.raises(Exception, match="not a Stokes"):
        spark.createDataFrame([("XX",)], "s string").select(Y.stokes_index("s")).collect()
    assert "point" in Y.COMPONENTS and "leakage" in Z.SOLVERS
    Y.VISIBILITY_HOOKS.append(lambda df: df.withColumn("m_re", F.col("m_re") + 1))
    try:
        s = spark.createDataFrame([(0, 0, 0, 0, 8, 8, 1.0, 0.0)], "k int, plane int, fracu int, fracv int, iu int, iv int, re double, im double")
        m = spark.createDataFrame([(0, 8, 8, 2.0)], "k int, x int, y int, value double")
        r = Y.predicted_from(s, m, G.kernel_table(spark, G.box_kernel()), 16, ["k"]).first()
        assert (r.m_re, r.m_im) == pytest.approx((3.0, 0.0))
    finally:
        Y.VISIBILITY_HOOKS.clear()


def test_images_move_by_fractions(spark):
    df = spark.createDataFrame([(0, 3, 5, 1.0)], "k int, x int, y int, v double").withColumns({"sx": F.lit(0.25), "sy": F.lit(-1.5)})
    got = {(r.x, r.y): r.v for r in I.regridded(df, ["k", "sx", "sy"], "sx", "sy", ["v"]).collect()}
    assert got == pytest.approx({(3, 3): 0.375, (4, 3): 0.125, (3, 4): 0.375, (4, 4): 0.125})


def test_waiting_rows_are_held_as_arrays(spark, tmp_path, monkeypatch):
    """The state holds 24 bytes a waiting row, and scans are told some TOLD at a time."""
    import pandas as pd
    from pyspark.sql import GroupedData

    class State:
        exists, get, mark = False, None, 0

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, values):
            self.exists, self.get = True, values

        def setTimeoutTimestamp(self, ms):
            pass

    seen, state = {}, State()
    monkeypatch.setattr(S, "TOLD", 50, raising=False)
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, run, *a: seen.update(run=run))
    (tmp_path / "in").mkdir()
    S.scan_sessions(spark.readStream.schema(S.EVENTS).parquet(str(tmp_path / "in")))
    n = 300
    rows = pd.DataFrame({"us": [(n - i) * 10**6 for i in range(n)], "event_id": range(n), "field": [i // 2 % 3 for i in range(n)]})
    first = list(seen["run"]((4,), iter([rows[:100], rows[100:]]), state))
    assert max(map(len, first)) <= 50 and sum(x["n"].sum() for x in first) == n and not any(x["closed"].any() for x in first)
    assert isinstance(state.get[1], bytes) and len(state.get[1]) == 24 * n
    state.mark = 10**9
    last = pd.concat(seen["run"]((4,), iter([]), state))
    assert len(state.get[1]) == 0 and last["n"].sum() == n and len(last[last["closed"]]) == 150 and last["begin_s"].min() == 1.0


def test_phases_are_not_filled_from_samples_without_a_channel(spark, tmp_path):
    """Null channels come last, as in SQL: they take the phase of the last good channel and give none to the first."""
    duckdb = pytest.importorskip("duckdb")
    cells = [(1, 16.0, 0.09, 0.09, "R"), (1, 1.0, 0.09, 0.05, "N"), (1, None, 0.02, 0.07, "N"), (2, 3.0, 0.06, 0.08, "A"), (2, None, 0.06, 0.01, "R")]
    lines = [(i, 4, k, 1, q, 1.0, d, t, f, "O", "1996-01-02") for i, (k, q, d, t, f) in enumerate(cells)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(lines, names).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["phase_fill"](spark, str(tmp_path)).collect()}
    assert got == set(c.sql(SQL["phase_fill"]).fetchall())
    assert (1, 4, 0, 0.0) in got
