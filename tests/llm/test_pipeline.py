"""Each stage against the brute-force version of its operator, on its own input."""

import corpus_pipeline as cp
from test_op01_line_dedup import brute as lines_by_hand
from test_op03_ngram_jaccard import brute as groups_by_hand
from test_op06_suffix_dedup import brute as bytes_by_hand
from test_op08_packing import checked

from fringeworks.llm import op10_quality_crf
from fringeworks.llm.common import Scratch


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "jaccard", "suffix_dedup", "packing"] and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, scratch, seen = docs.columns, Scratch(spark), [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == names and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        seen.append(scratch.save(out))
    raw, good, lined, single, final = (rows(d) for d in seen)
    model = op10_quality_crf.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good == [(d, t) for d, t in raw if model.scores([(t or "").encode()])[0] >= 0.5]
    assert lined == [(d, t) for d, t in lines_by_hand(good) if t is None or t.strip() or (d, t) in set(good)]
    groups = groups_by_hand(lined)
    assert single == [(d, t) for d, t in lined if groups[d][1] == d]
    removed = {d: (n, k) for d, n, k, *_ in bytes_by_hand(single)}
    assert {d for d, _ in final} == {d for d, (n, k) in removed.items() if n == 0 or k < n}
    for d, t in final:
        assert len(t.encode()) <= removed[d][0] - removed[d][1]
    for r in seen[-1].collect():
        assert r.n_chars == len(r.text)
    packed = cp.packing(spark, seen[-1], sf_dir).collect()
    assert checked(packed, final) == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_odd_documents_pass_through(spark, make_docs, sf_dir):
    docs = make_docs([(1, None), (2, ""), (None, "Some plain line ends."), (3, "Some plain line ends."), (3, "Some plain line ends.")])
    for _, stage in cp.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} >= {1, 2}
    empty = make_docs([])
    for _, stage in cp.STAGES:
        empty = Scratch(spark).save(stage(spark, empty, sf_dir))
    assert empty.count() == 0


def test_clashing_columns_repeated_ids_and_long_texts(spark, make_docs, clash, sf_dir):
    """Extra columns come through every stage; other texts of a doc_id are documents of their own; a text of a million words is one document."""
    good = ["The quiet river moved slowly past the old mill house.", "Children walked along the narrow path towards the village.", "Later that evening the rain began to fall again."]
    body = lambda seed: "\n".join(f"{s[:-1]} in the year {seed} number {k}." for k in range(6) for s in good)
    long = "\n".join(f"The quiet river moved slowly past mill number {k} in the old valley of the north." for k in range(60_000))
    rows = [(1, body(1)), (1, body(2)), (2, body(1)), (2, body(3)), (None, body(4)), (3, long), (3, long)]
    docs = make_docs(rows, clash)
    names = docs.columns
    for name, stage in cp.STAGES[1:-1]:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
        assert docs.columns == names, name
    kept = docs.collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, None} and sum(r.doc_id == 3 for r in kept) == 1
    assert all(r.n_chars == len(r.text) and r.label == "x" for r in kept)
    assert next(r for r in kept if r.doc_id == 3).text.startswith("The quiet river moved slowly past mill number 0")
    out = cp.packing(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None}
