import hashlib
import random

import numpy as np

from fringeworks.llm import op06_suffix_dedup as op


def brute(rows, length=50):
    first = {}
    key = lambda d: -(1 << 63) if d is None else d
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, key(d)), key(d))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < key(d):
                gone[p : p + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in op.digests(df).collect()), key=str)


def fixture():
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 200)))) for i in range(150)]
    rows += [(1000 + i, "x" * n) for i, n in enumerate([0, 49, 50, 51, 200, 3000])] + [(1100 + i, ("lorem ipsum dolor sit amet " * 20)[i:]) for i in range(30)]
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(90))
    rows += [(2000 + i, "".join(rnd.choice("klmnop é") for _ in range(60)) + passage[rnd.randint(0, 45) :] + "".join(rnd.choice("qrstu") for _ in range(40))) for i in range(60)]
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(120_000))
    rows += [(3000, long), (3001, long[50_000:] + "tail"), (3002, None), (3003, ""), (None, passage), (2005, rows[0][1]), (2005, passage * 2)]
    return rows


def test_same_bytes_as_brute_force(make_docs, clash):
    rows = fixture()
    assert got(make_docs(rows, clash)) == brute(rows)


def test_small_batches_give_the_same(make_docs, spark):
    """Groups that span batches: the stream's kept rows are enough."""
    rows = fixture()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(make_docs(rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table_and_text_form(make_docs, clash):
    assert got(make_docs([])) == []
    p = "é" * 40 + "0123456789" * 4
    out = {r.doc_id: r.text for r in op.dedup_bytes(make_docs([(1, p), (2, "head " + p + " tail"), (3, None)], clash)).collect()}
    assert out == {1: p, 2: "head  tail", 3: None}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.query(spark, sf_dir).collect()), key=str) == brute(rows)
