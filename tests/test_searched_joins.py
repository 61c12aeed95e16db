"""As-of and interval joins by search and by buckets, against loops: the same rows either way."""

import random

import pytest
from pyspark.sql import functions as F

from fringeworks.operators import joins as J


@pytest.mark.parametrize("small", [0, J.SMALL])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_a_loop(spark, small, forward):
    rnd = random.Random(1)
    left = [(i, rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y"]), rnd.choice([None, float(rnd.randrange(-30, 60))])) for i in range(200)]
    right = [(k, b, float(s), f"{k}{b}{s}") for k in (1, 2, None) for b in ("x", "y") for s in rnd.sample(range(-20, 50), 9)] + [(1, "x", None, "never")]
    a = spark.createDataFrame(left, "id int, k int, b string, t double")
    c = spark.createDataFrame(right, "kk int, bb string, s double, name string")
    got = {r.id: (r.name, r.s) for r in J.asof(a, c, {"k": "kk", "b": "bb"}, "t", "s", ["name"], forward=forward, bucket=7.0, small=small).collect()}
    for i, k, b, t in left:
        own = [(s, n) for kk, bb, s, n in right if (kk, bb) == (k, b) and s is not None and t is not None and (s >= t if forward else s <= t)]
        best = (min(own) if forward else max(own)) if own else (None, None)
        assert got[i] == (best[1], best[0]), (i, k, b, t)
    assert len(got) == 200


@pytest.mark.parametrize("small", [0, J.SMALL])
def test_no_solutions_and_clashing_names(spark, small):
    a = spark.createDataFrame([(1, 2.0)], "k int, t double")
    none = spark.createDataFrame([], "k int, t double, x int")
    r = J.asof(a, none, {"k": "k"}, "t", "t", ["x"], small=small).collect()
    assert [tuple(x) for x in r] == [(1, 2.0, None, None)] and r[0].__fields__ == ["k", "t", "x", "t_r"]
    assert [tuple(x) for x in J.first_interval(a, spark.createDataFrame([], "k int, a double, b double, n int"), "t", ["k"], "a", "b", "n", small=small).collect()] == [(1, 2.0, None)]


@pytest.mark.parametrize("small", [0, J.SMALL])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_first_interval_with_open_ends(spark, small, keys):
    rnd = random.Random(2)
    pts = [(i, rnd.choice([1, 2, None]), rnd.choice([float(rnd.randrange(-10, 60)), 1e13, 2e13, -1e12, None])) for i in range(150)]
    ends = [0.0, 7.0, 20.0, 1e11, 1e13, float("inf")]
    iv = [(n, rnd.choice([1, 2, None]), float(rnd.randrange(-10, 60)), rnd.choice(ends)) for n in range(25)] + [(99, 1, float("-inf"), -1e11)]
    got = {r.id: r.n for r in J.first_interval(spark.createDataFrame(pts, "id int, k int, t double"), spark.createDataFrame(iv, "n int, k int, a double, b double").drop(*[] if keys else ["k"]), "t", keys, "a", "b", "n", bucket=8.0, small=small).collect()}
    for i, k, t in pts:
        own = [n for n, kk, a, b in iv if (not keys or kk == k) and t is not None and a <= t <= b]
        assert got[i] == (min(own) if own else None), (i, k, t)


def test_samples_of_an_asof_join_do_not_move(spark):
    left = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("k"), F.col("id").cast("double").alias("t"))
    right = spark.range(50).select((F.col("id") % 7).cast("int").alias("k"), (F.col("id") * 20.0).alias("s"), F.col("id").alias("x"))
    plan = J.asof(left, right, {"k": "k"}, "t", "s", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
