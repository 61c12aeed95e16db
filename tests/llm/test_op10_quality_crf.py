import itertools
import zlib

import numpy as np
import pytest

from fringeworks.llm import op10_quality_crf as op


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4, 2])
    emit, trans, begin = rng.normal(size=(10, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, pairs, norm = op.forward_backward(emit, trans, begin, counts)
    at, total, expected_pairs = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = begin[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            weight[path] = np.exp(s)
        z = sum(weight.values())
        total += np.log(z)
        for i in range(n):
            assert marginal[at + i, 1] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / z)
        for p, w in weight.items():
            for a, b in itertools.pairwise(p):
                expected_pairs[a, b] += w / z
        at += n
    assert norm == pytest.approx(total) and pairs == pytest.approx(expected_pairs)


def test_line_features_by_hand():
    x, size, counts = op.line_features([b"The cat sat. The cat", b"", "ÉÉ|  A A A\n##!".encode()])
    assert counts.tolist() == [1, 1, 2] and size.tolist() == [20, 0, 12, 3]
    assert x[0, 1] == pytest.approx(np.log1p(5)) and x[0, 8] == pytest.approx(2 / 5) and x[0, 7] == 0
    assert x[2, 7] == pytest.approx(2 / 4) and x[2, 3] == pytest.approx(1 / 4) and x[3, 2] == 2 and not x[1, :6].any()


def test_neighbours_stay_inside_a_text():
    f = op.with_neighbours(np.arange(3.0)[:, None] + 1, np.array([2, 1]))
    assert f.tolist() == [[1, 0, 2, 1, 0, 1], [2, 1, 0, 0, 1, 1], [3, 0, 0, 1, 1, 1]]


def labelled():
    good = [(i, f"Some plain line number {i} ends.\nAnother one follows here.", 1) for i in range(60)]
    bad = [(100 + i, f"BUY$$$ NOW### {i}%%%\nCHEAP*** PILLS&&&", 0) for i in range(60)]
    return good + bad


def test_learns_without_held_out_rows_and_scores_all(spark, make_docs, clash):
    rows = labelled()
    docs = make_docs([(d, t) for d, t, _ in rows] + [(500, None), (501, ""), (None, "Plain text here."), (502, "A fine line follows.\n" * 30_000), (0, rows[0][1])], clash)
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(None, 1, 0), (777, None, 0)], "doc_id long, quality int, toxic int")
    model = op.trained(docs, labels)
    out = op.scored(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(by[d].predicted == q for d, _, q in rows) and by[502].predicted == 1
    for d in (0, 1, 2, 3):
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    x, counts, y = op.training_rows(docs, labels)
    assert len(y) == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, _, _ in rows)  # doc 0 has two texts: one of them
    assert counts.sum() == len(x)


def test_training_is_bounded_by_documents_and_lines(spark, make_docs, monkeypatch):
    ids = [d for d in range(60) if zlib.crc32(str(d).encode()) % 3 != 1]
    docs = make_docs([(d, "one line\n" * 9) for d in ids] * 3)
    labels = spark.createDataFrame([(d, d % 2, 0) for d in ids], "doc_id long, quality int, toxic int")
    assert op.training_rows(docs, labels)[1].tolist() == [10] * len(ids)
    monkeypatch.setattr(op, "TRAIN_LINES", 105)
    assert op.training_rows(docs, labels)[1].tolist() == [10] * 10


def test_without_labels_and_without_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "x"), (2, None)])
    assert {r.score for r in op.scored(docs, op.trained(docs, none)).collect()} == {0.5}
    assert op.scored(make_docs([]), op.trained(make_docs([]), none)).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in op.query(spark, sf_dir).collect()}
    pairs = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(pairs) > 20 and np.mean([a == b for a, b in pairs]) >= 0.95
