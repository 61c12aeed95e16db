import numpy as np
from compare import rows_of

from fringeworks.llm import op04_topk_cover_tree as op


def run(spark, rows, k=3, every=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = op.vectors(df, "vec_id", "embedding")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op.top_k(v.where(f"id % {every} = 0"), v, k).collect())


def brute(rows, k=3, every=2):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out |= {(i, n + 1, j, -t) for n, (t, j) in enumerate(s[:k])}
    return sorted(out)


def test_trees_find_the_best_with_ties():
    rng = np.random.default_rng(0)
    for n, dim, spread in ((1, 2, 9), (50, 3, 2), (700, 8, 1000), (900, 2, 3)):
        x = rng.integers(-spread, spread + 1, (n, dim)).astype(float)
        ids = rng.permutation(n).astype(np.int64)
        found, _ = op.dual_tree_topk(x[: n // 2 + 1], ids[: n // 2 + 1], x, ids, 5)
        for i, got in enumerate(found):
            s = x @ x[i]
            want = sorted((-s[j], ids[j]) for j in range(n) if j != i)[:5]
            assert [tuple(g) for g in got] == [(-a, b) for a, b in want]


def test_clustered_data_is_pruned():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 1000
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16))).round()
    ids = np.arange(4000)
    _, products = op.dual_tree_topk(x[:200], ids[:200], x, ids, 10)
    assert products < 0.3 * 200 * 4000


def test_odd_vectors_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0, 2.0]), (8, [1.0]), (9, [-0.5]), (None, [1.0, 1.0]), (10, [-1.0, -2.0]), (11, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(3 * i - 2**19)]) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def test_blocks_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    monkeypatch.setattr(op, "LEAST_BLOCK", 30)
    monkeypatch.setattr(op, "MOST_BLOCK", 30)
    monkeypatch.setattr(op, "QUERIES", 40)
    monkeypatch.setattr(op, "SAMPLE", 50)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_scores_beyond_a_long_and_fractions_below_the_largest_doubles(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([2.0**60, 2.0**61, 2.0**61, -(2.0**61), -(2.0**62), 2.0**42 + 0.0009765625 / 4, -(2.0**41) - 0.000244140625])]
    df = spark.createDataFrame([*rows, (99, [1.7e308, 0.0])], "vec_id long, embedding array<double>")
    v = op.vectors(df, "vec_id", "embedding")
    got = [(r.query_id, r["rank"], r.vec_id) for r in op.top_k(v, v, 7).orderBy("query_id", "rank").collect()]
    from fractions import Fraction
    from math import floor

    own = {i: [floor(Fraction(y) * 1024) for y in x] for i, x in rows}
    want = []
    for i, q in own.items():
        s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in own.items() if j != i)
        want += [(i, n + 1, j) for n, (_, j) in enumerate(s)]
    assert got == want


def test_levels_cover_their_points_by_centres_apart():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    todo = [op.CoverTree(x, np.arange(600), 8)]
    while todo:
        node = todo.pop()
        gap = lambda c, rows: np.sqrt(((x[rows] - c) ** 2).sum(1))
        assert gap(node.centre, node.rows).max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            level = max(c.radius for c in node.children)
            centres = np.array([c.centre for c in node.children])
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(centres), 1)]
            assert len(node.children) <= op.FAN and apart.min() >= level
            todo += node.children


def test_a_vector_that_a_third_of_all_rows_share(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 17), 1.0]) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_query_is_the_sql(spark, duck, sf_dir):
    assert rows_of(op.query(spark, sf_dir).toPandas()) == rows_of(duck.sql(op.SQL).df())


def test_extra_columns_with_names_used_inside(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "s", 2.0) for r in rows], "vec_id long, embedding array<float>, cell int, dim string, score double")
    v = op.vectors(df, "vec_id", "embedding")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op.top_k(v.where("id % 2 = 0"), v, 3).collect()) == brute(rows)
