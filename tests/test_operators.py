import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.operators import aggregates as A
from fringeworks.operators import calibrate as K
from fringeworks.operators import deconv as D
from fringeworks.operators import gridding as G
from fringeworks.operators import images as I  # noqa: E741
from fringeworks.operators import joins as J
from fringeworks.operators import select as P


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.uniform(-6, 6)), float(rng.uniform(-6, 6)), float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, u double, v double, re double, im double").withColumns({"freq": F.lit(1.0), "k": F.lit(0)})
    return P.with_uv_cells(df.withColumn("plane", F.lit(0)), 1.0, 4, 32, wavelengths=True)


def test_degridding_is_the_adjoint_of_gridding(spark, samples):
    kernel = G.kernel_table(spark, G.spheroidal_kernel(3, 4))
    grid = G.gridded(samples, kernel, Cx.of("re", "im"), F.lit(1.0), ["k"])
    other = grid.select("k", "gu", "gv", (F.col("gu") * 0.1).alias("re"), (F.col("gv") * 0.2 - 1).alias("im"))
    back = G.degridded(samples, kernel, other, ["k"], ["row_id"])
    left = grid.alias("a").join(other.alias("b"), ["k", "gu", "gv"]).agg(F.sum(F.expr("a.re * b.re + a.im * b.im"))).first()[0]
    right = samples.alias("a").join(back.alias("b"), "row_id").agg(F.sum(F.expr("a.re * b.re - a.im * b.im"))).first()[0]
    assert left == pytest.approx(right, rel=1e-9)


def test_transform_of_box_grid_equals_direct_sum(spark, samples):
    snapped = samples.withColumns({"u": (F.col("iu") - 16) / 32.0, "v": (F.col("iv") - 16) / 32.0})
    grid = G.gridded(samples.withColumns({"fracu": F.lit(0), "fracv": F.lit(0)}), G.kernel_table(spark, G.box_kernel()), Cx.of("re", "im").conj(), F.lit(1.0), ["k"])
    image = G.images_of(grid, ["k"], 32).where("x IN (10, 16, 20) AND y IN (3, 16, 30)").toPandas().set_index(["x", "y"])["value"]
    px = spark.createDataFrame([(x, y, float(x - 16), float(y - 16)) for x in (10, 16, 20) for y in (3, 16, 30)], "x int, y int, l double, m double")
    direct = G.direct_image(snapped, px, ["k"]).toPandas().set_index(["x", "y"])["value"] * 200
    assert all(image[k] == pytest.approx(direct[k], abs=1e-8) for k in direct.index)


@pytest.mark.parametrize("at", [(50, 50), (0, 0), (70, 20), (99, 99)])
def test_hogbom_finds_a_delta(at):
    dirty, psf = np.zeros((100, 100)), np.zeros((100, 100))
    dirty[at], psf[50, 50] = 1.0, 1.0
    model, residual, cause = D.hogbom(dirty, psf, D.Control(3, 1.0), np.full((100, 100), 10.0))
    assert cause == "CONVERGED" and model[at] == 1.0 and not residual.any()


def test_hogbom_of_an_empty_image_converges():
    assert D.hogbom(np.zeros((8, 8)), np.eye(8), D.Control())[2] == "CONVERGED"


def test_control_sees_divergence_and_the_cap():
    c = D.Control(max_iterations=2)
    assert c.cause(0, 1.0) is None and c.cause(1, 2.5) == "DIVERGED" and c.cause(2, 0.5) == "EXCEEDEDITERATIONS"


def test_multi_term_recovers_two_taylor_terms():
    psf = np.zeros((32, 32))
    psf[16, 16] = 1.0
    dirty = [np.zeros((32, 32)), np.zeros((32, 32))]
    dirty[0][10, 12], dirty[1][10, 12] = 1.0 + 0.05 * 0.5, 0.05 + 0.02 * 0.5
    model, _, _ = D.multi_term(dirty, [psf, psf * 0.05, psf * 0.02], [0.0], D.Control(60, 0.5, absolute=1e-8))
    assert model[0][10, 12] == pytest.approx(1.0, abs=1e-3) and model[1][10, 12] == pytest.approx(0.5, abs=1e-2)


def test_fista_and_entropy_move_towards_the_source():
    x, y = np.indices((32, 32))
    psf = np.exp(-((x - 16) ** 2 + (y - 16) ** 2) / 8)
    truth = np.zeros((32, 32))
    truth[20, 9] = 1.0
    dirty = D.fft_convolve(truth, psf)
    assert D.peak_of(D.fista(dirty, psf, 1e-3, 100)) == (20, 9)
    for kind in ("emptiness", "information"):
        loose, tight = (D.maximum_entropy(dirty, psf, sigma, 0.05, 80, kind) for sigma in (0.1, 0.01))
        assert D.peak_of(tight[0]) == (20, 9) and tight[1] < loose[1] and np.abs(tight[0] - loose[0]).max() > 1e-3


def test_filters_keep_the_peak_and_beams_fit():
    x, y = np.indices((64, 64))
    psf = D.gaussian_beam((64, 64), 8.0, 5.0, 0.4)
    for f, arg in ((D.robust_filter, 0.0), (D.wiener_filter, 0.1), (D.gaussian_taper, 4.0)):
        assert f(psf, psf, arg)[0].max() == pytest.approx(psf.max())
    major, minor, angle = D.fit_beam(psf)
    assert (major, minor) == pytest.approx((8.0, 5.0), rel=1e-3)
    assert math.tan(angle) == pytest.approx(math.tan(0.4), rel=1e-2)
    tapered = D.gaussian_taper(psf, psf, 6.0)[0]
    assert D.fit_beam(tapered)[0] == pytest.approx(10.0, rel=2e-2)


def test_gram_schmidt_is_orthonormal():
    b = D.gram_schmidt([D.scale_function((16, 16), s) for s in (0, 3, 6)])
    assert np.array([[(p * q).sum() for p in b] for q in b]) == pytest.approx(np.eye(3), abs=1e-9)


def test_gain_solution_recovers_gains():
    rng = np.random.default_rng(1)
    g = rng.uniform(0.8, 1.2, 8) * np.exp(1j * rng.uniform(-0.5, 0.5, 8))
    v = np.outer(g, g.conj())
    p = np.ones((8, 8)) - np.eye(8)
    got = K.solve_gains(v * p, p, 200)
    assert got == pytest.approx(g * np.conj(g[0]) / abs(g[0]), abs=1e-6)


def test_correct_undoes_corrupt(spark):
    a, b, v = Cx.of(F.lit(0.9), F.lit(0.2)), Cx.of(F.lit(1.1), F.lit(-0.3)), Cx.of(F.lit(2.0), F.lit(1.0))
    z = K.corrected(K.corrupted(v, a, b), a, b)
    assert list(spark.range(1).select(*z.cols("x", "y")).first()) == pytest.approx([2.0, 1.0])


def test_delays(spark):
    rows = [(a, c, math.cos(2 * math.pi * a * 1e-8 * c * 1e6), math.sin(2 * math.pi * a * 1e-8 * c * 1e6)) for a in range(3) for c in range(32)]
    got = {r.a: r.delay for r in K.solved_delays(spark.createDataFrame(rows, "a int, chan int, re double, im double"), ["a"], 1e6).collect()}
    assert got == {a: pytest.approx(a * 1e-8, abs=1e-12) for a in range(3)}
    assert K.antenna_delays([(0, 1, -1.0), (1, 2, -1.0), (0, 2, -2.0)], 0) == {0: pytest.approx(0, abs=1e-9), 1: pytest.approx(1.0), 2: pytest.approx(2.0)}


def test_asof_takes_the_last_at_or_before_and_null_without(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 0.5), (3, "b", 9.0), (4, None, 5.0)], "id int, k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 20), ("a", 6.0, 30)], "k string, s double, x int")
    back = {r.id: r.x for r in J.asof(left, right, {"k": "k"}, "t", "s", ["x"]).collect()}
    ahead = {r.id: r.x for r in J.asof(left, right, {"k": "k"}, "t", "s", ["x"], forward=True).collect()}
    assert back == {1: 20, 2: None, 3: None, 4: None} and ahead == {1: 20, 2: 10, 3: None, 4: None}


def test_first_interval_wins_and_ends_belong(spark):
    t = spark.createDataFrame([(float(x),) for x in range(8)], "t double")
    i = spark.createDataFrame([(0, 1.0, 3.0), (1, 3.0, 5.0), (2, 2.0, 6.0)], "n int, a double, b double")
    got = {r.t: r.n for r in J.first_interval(t, i, "t", [], "a", "b", "n").collect()}
    assert got == {0.0: None, 1.0: 0, 2.0: 0, 3.0: 0, 4.0: 1, 5.0: 1, 6.0: 2, 7.0: None}


def test_wrong_channel_ranges_and_unknown_fields_are_errors(spark):
    v = spark.createDataFrame([(0, 0)], "chan int, field_id int")
    with pytest.raises(ValueError):
        P.channel_range(v, 1, 5, 2, 16)
    with pytest.raises(ValueError):
        P.named_fields(v, spark.createDataFrame([(0, "x")], "field_id int, name string"), ["y"])


def test_normal_equations_solve_a_line(spark):
    df = spark.range(20).select(F.lit(1.0).alias("one"), F.col("id").cast("double").alias("t"), (2.0 + 3.0 * F.col("id")).alias("y"))
    n = {(r.row_par, r.col_par): r.value for r in A.normal_equations(df, ["one", "t"], F.col("y"), F.lit(1.0)).collect()}
    assert A.solved(n, ["one", "t"]) == pytest.approx([2.0, 3.0])


def test_statistics_leave_out_nan(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, float("nan"))], "c int, value double")
    r = A.image_statistics(df, ["c"]).first()
    assert (r["mean"], r["median"], r["madfm"], r["max"]) == (2.0, 2.0, 1.0, 3.0)


def test_oversampling_keeps_old_pixels_and_regrid_is_exact_on_pixels():
    rng = np.random.default_rng(0)
    a = D.fft_convolve(rng.normal(size=(16, 16)), D.gaussian_beam((16, 16), 5, 5, 0))
    assert I.oversampled(a, 2)[::2, ::2] == pytest.approx(a, abs=1e-9)
    x, y = np.indices(a.shape).astype(float)
    assert I.regrid(a, x, y) == pytest.approx(a) and I.regrid(a, x + 0.4, y, "nearest") == pytest.approx(a)
    assert I.sensitivity_loss(a, a) == pytest.approx(1.0)


def test_w_kernel_of_the_middle_plane_is_real():
    rows = [x for x in G.w_kernels(50.0, 3, 100.0, 3, 2, 32) if x[0] == 1]
    assert rows and max(abs(x[6]) for x in rows) < 1e-9
    assert sum(x[5] for x in rows if (x[1], x[2]) == (0, 0)) == pytest.approx(1.0, abs=0.05)


def test_kernels_can_be_registered():
    G.register_kernel("twin", lambda: [(0, 0, 0, 0, 0, 0.5, 0.0), (0, 0, 0, 1, 0, 0.5, 0.0)])
    assert len(G.KERNELS["twin"]()) == 2


def test_filters_reach_the_scan(spark, sf_dir):
    from fringeworks.sources.driver_tables import table

    plan = P.cross_correlations(table(spark, sf_dir, "vis").where("NOT flag")).groupBy("scan").count()._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("Exchange") <= 1


def test_quantiles_of_few_groups_do_not_move_the_values(spark):
    """Values meet the brackets of their group where they lie; joined by group, each group would be one task's."""
    df = spark.createDataFrame([("XX" if i % 3 else None, float(i % 50)) for i in range(600)], "pol string, w double")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = A.quantiles(df, ["pol"], F.col("w"), {"half": 0.5, "top": 1.0})
        plan = q._jdf.queryExecution().executedPlan().toString()
        got = {r.pol: (r.half, r.top) for r in q.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan
    for k in ("XX", None):
        own = [float(i % 50) for i in range(600) if (i % 3 > 0) == (k == "XX")]
        assert got[k] == (np.quantile(own, 0.5), 49.0)
