import hashlib
import math
import random

import numpy as np
import pytest
from compare import rows_of

from fringeworks.llm import op13_vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    rows = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            at = [best(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                if mine := [c[p] for c, a in zip(cut, at, strict=True) if a == e]:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in r) for r in last]
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in r), err, by_label[label], digest) for (i, _, label), r, err in zip(rows, last, errors, strict=True)), key=str)


def run(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, op.compressed(spark.createDataFrame(rows, schema)).collect()), key=str)


def plain_nearest(x, c):
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    return np.array([list(r).index(min(r)) for r in d])


@pytest.mark.parametrize("scale", [3, 50, 4096, 1 << 20, (1 << 28) - 1])
@pytest.mark.parametrize("width", [1, 8, 32])
def test_screen_never_loses_the_nearest(scale, width):
    rng = np.random.default_rng(scale + width)
    c = rng.integers(-scale, scale + 1, (16, width))
    c[9] = c[4]
    c[10] = c[3] + 1
    near = c[rng.integers(0, 16, 300)] + rng.integers(-2, 3, (300, width))
    half = (c[rng.integers(0, 16, 300)] + c[rng.integers(0, 16, 300)]) // 2
    x = np.concatenate([near, half, rng.integers(-scale, scale + 1, (300, width))])
    x = np.clip(x, -scale, scale)
    want = plain_nearest(x, c)
    assert op.screened(x, c)[np.arange(len(x)), want].all()
    assert (op.nearest(x, c) == want).all()


def test_screen_spares_most_of_the_exact_work():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-900, 900, (5000, 8)), rng.integers(-900, 900, (16, 8))
    assert op.screened(x, c).sum() < 1.02 * len(x)


def test_rows(spark):
    rnd = random.Random(13)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(16)], rnd.choice([0, 1, 2, None])) for i in range(5, 200)]
    rows += [(3, None, 1), (4, [0.1] * 15 + [None], 1), (2, [0.1] * 15 + [float("nan")], 1), (1, [0.1] * 15 + [float("inf")], 2), (900, [], 2)]
    rows += [(300 + i, [0.25, -0.25] * 8, 7) for i in range(120)] + [(400, [0.5] * 16, None)] * 3 + [(None, [0.01] * 16, None)]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_few_vectors_equal_vectors_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    assert run(spark, [(1, [1.0] * 12, 1), (2, [1.0] * 16, 1)]) == []
    for rows in ([(1, [0.5] * 8, None)], [(i, [0.5] * 8, i % 2) for i in range(40)], [(i, [i / 7.0] * 8, 1) for i in range(9)]):
        assert run(spark, rows) == brute(rows)


def test_other_lengths_take_no_part(spark):
    rows = [(i, [i / 9.0] * 8, 1) for i in range(30)]
    assert run(spark, [*rows, (50, [1.0] * 16, 1), (51, [1.0], 1)]) == brute(rows)


def test_huge_components(spark):
    rnd = random.Random(14)
    rows = [(i, [rnd.uniform(-1, 1) * rnd.choice([1, 1e3, 1e5]) for _ in range(8)], 0) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    got = run(spark, [(i, [1e12 * i] * 8, 0) for i in range(40)])
    assert len(got) == 40 and max(r[2] for r in got) == op.LONG


def test_clashing_columns(spark):
    rows = [(i, [i / 9.0] * 8, i % 3, "x", 1.0, 2) for i in range(30)]
    assert run(spark, rows, "vec_id long, embedding array<float>, label int, code string, error double, n int") == brute([r[:3] for r in rows])


def test_query_is_the_sql(spark, duck, sf_dir):
    assert rows_of(op.query(spark, sf_dir).toPandas()) == rows_of(duck.sql(op.SQL).df())
