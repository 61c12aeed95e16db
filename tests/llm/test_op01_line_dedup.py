from compare import rows_of

from fringeworks.llm import op01_line_dedup as op


def brute(rows, size=3):
    """Windows of non-blank lines over the corpus in order of doc_id; null first."""
    first, gone, parsed = {}, {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        parsed[doc, text] = lines
        hits = set()
        for k in range(len(at) - size + 1):
            w = tuple(lines[i] for i in at[k : k + size])
            if w in first:
                hits |= set(at[k : k + size])
            else:
                first[w] = 1
        gone[doc, text] = hits
    return sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(parsed[d, t]) if i not in gone[d, t])) for d, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.text) for r in op.dedup_lines(df).select("doc_id", "text").collect()), key=str)


CASES = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, None), (5, ""), (6, "a\nb"), (7, "q\nq\nq\nq\nq"), (8, " \n\na\n\nb\n \nc\nz"), (3, "a\nb\nc"), (None, "m\nn\no"), (9, "m\nn\no\np"), (10, "\n".join(f"line {i}" for i in range(3000))), (11, "\n".join(f"line {i}" for i in range(1500, 3000)))]


def test_cases_and_clashing_columns(make_docs, clash):
    df = make_docs(CASES, clash)
    assert got(df) == brute(CASES)
    assert set(clash) <= set(op.dedup_lines(df).columns)


def test_empty_table(make_docs):
    assert got(make_docs([])) == []


def test_query_is_the_sql(spark, duck, sf_dir):
    a, b = rows_of(op.query(spark, sf_dir).toPandas()), rows_of(duck.sql(op.SQL).df())
    assert a == b


def test_very_long_texts(make_docs, clash):
    """A hundred thousand lines of which another document has the middle."""
    lines = [f"line number {k} of a long text" for k in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["begin", *lines[40_000:60_000], "end"]))]
    got = {r.doc_id: (r._fw_removed, r.text) for r in op.dedup_lines(make_docs(rows, clash)).collect()}
    assert got[1][0] == 0 and got[2] == (20_000, "begin\nend")
