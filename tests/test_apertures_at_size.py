"""What grid_a_w_stack takes at size: filters that stay short, epochs without a shuffle of samples, kernels as arrays."""

import math

import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.operators import apertures as AP
from fringeworks.operators import select as P
from fringeworks.plans import solvers as Q


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_planes_and_cells_are_short_filters(spark, n):
    assert str(P.w_plane("w", 2.0, n, clip=True)).count("w") <= 4 + (n % 2 == 0)
    assert str(P.on_grid("iu", "iv", 2, 64, 64)).count("iu") == 1
    ws = [k / 4 for k in range(-40, 41)] + [None]
    got = [r.p for r in spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "i int, w double").select("i", P.w_plane("w", 2.0, n, clip=True).alias("p")).orderBy("i").collect()]
    plane = lambda w: math.copysign(math.floor(abs(w / 2) + 0.5), w) + (n - 1) // 2
    assert got == [int(plane(w)) if w is not None and 0 <= plane(w) < n else -1 for w in ws]


@pytest.mark.parametrize(("support", "n"), [(0, 8), (2, 8), (1, 9), (4, 8)])
def test_cells_on_the_grid(spark, support, n):
    cells = spark.range(-3, n + 4).select(F.col("id").cast("int").alias("iu"), F.lit(n // 2).alias("iv"))
    got = {r.iu for r in cells.where(P.on_grid("iu", "iv", support, n, n)).collect()}
    assert got == {i for i in range(-3, n + 4) if support + 1 <= i <= n - support - 1 and support + 1 <= n // 2 <= n - support - 1}


def test_epochs_are_looked_up_without_a_shuffle(spark):
    rows = [(i % 3, i % 2, float(i), 0.1 * (i // 50), 0.0, 0.0) for i in range(200)] + [(None, 1, 3.0, 0.0, 0.0, 0.0), (1, 1, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "field_id int, feed int, time_s double, l double, m double, pa double")
    out = AP.with_epochs(df, 0.01, 0.1, 35.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.time_s, r.epoch) for r in out.collect()) == [(float(i), 1 + i // 50) for i in range(200)]
    assert out.columns == [*df.columns, "epoch"]


def test_kernels_as_arrays_give_what_the_join_gives(spark):
    rows = [(i % 3, i % 2, 1, i % 2, i % 4, i % 3, 8 + i % 5, 9 + i % 7, i % 2, math.sin(i), math.cos(i), 1.0 + i % 3) for i in range(120)]
    rows += [(0, 0, 1, 0, 1, 1, 40, 40, 0, None, 1.0, 2.0), (0, 0, 1, 0, 1, 1, 8, 9, 0, None, 1.0, 2.0), (0, 0, 1, 0, 1, 1, 60, 60, 0, 1.0, 1.0, None), (None, 0, 1, 0, 1, 1, 8, 9, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "field_id int, feed int, epoch int, band int, fracu int, fracv int, iu int, iv int, wp int, re double, im double, wt double")
    df = df.withColumns({"l": 0.003 * F.col("feed"), "m": 0.002 * F.col("field_id"), "pa": F.lit(0.0), "freq": 1.1e9 + 1e8 * F.col("band")})
    table = AP.kernels(df.where("field_id IS NOT NULL"), Q.dish, 1.0, 2, 4)
    found = []
    for small in (500_000, 0):
        g = AP.gridded(df, table, Cx.of("re", "im").conj(), F.col("wt"), ["wp"], small=small)
        assert ("MapInArrow" in g._jdf.queryExecution().executedPlan().toString()) == (small > 0)
        found.append({(r.wp, r.gu, r.gv): (r.re, r.im, r.weight) for r in g.collect()})
    few, many = found
    assert few.keys() == many.keys() and any(v[0] is None and v[2] is not None for v in many.values()) and any(v[2] is None for v in many.values())
    for k in few:
        assert [x is None for x in few[k]] == [x is None for x in many[k]]
        assert [x for x in few[k] if x is not None] == pytest.approx([x for x in many[k] if x is not None], abs=1e-9)
