import hashlib
import random
import zlib

import pytest
from compare import rows_of

from fringeworks.llm import op11_merkle_manifest as op


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, path of every node): whole levels, as the definition says."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            s = nodes[a ^ 1] if a ^ 1 < len(nodes) else ""
            paths[i].append((a & 1, s))
            at[i] = a // 2
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        d, text, lang, source, n = r
        return sha(*map(field, (d, source, lang, None if n is None else n + more, text)))

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    keys = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in keys:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in langs[k]]) for k in keys}
    root, upper = tree([trees[k][0] for k in keys])
    out = []
    for k, up in zip(keys, upper, strict=True):
        for r, path in zip(langs[k], trees[k][1], strict=True):
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for right, s in path + up:
                node = sha(s, node) if right else sha(node, s)
            out.append((r[0], leaf(r), trees[k][0], root, sha(*(s for _, s in path + up)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21, 64, 100])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(i)).encode() for i in range(n)]
    root, paths = tree([x.decode() for x in leaves])
    levels = op.height(n)
    assert op.root_of(leaves, levels).decode() == root
    for i, auth in enumerate(op.traversed(leaves, levels)):
        assert [(a or b"").decode() for a in auth] == [s for _, s in paths[i]]
        assert op.folded(leaves[i], op.entries(auth, i)).decode() == root


def test_traversal_holds_few_nodes():
    levels, most = 10, 0
    walk = op.traversed([b"%064d" % i for i in range(1 << levels)], levels)
    for _ in walk:
        most = max(most, sum(len(s.stack) for s in walk.gi_frame.f_locals["stacks"]))
    assert most <= 2 * levels


def test_rows(make_docs, clash):
    rnd = random.Random(11)
    rows = [(i, rnd.choice(["", "text é日本 \n", None, "x" * 5000]), rnd.choice(["en", "en", "en", "de", None, "", "日本", "é"]), rnd.choice(["a", None])) for i in range(300)]
    rows += [(7, "again", "en", "a"), (7, "once more", "en", "a"), (5, "same", "de", "b"), (5, "same", "de", "b"), (None, "no id", "en", None), (None, None, None, None), (9, "alone", "fr", "s")]
    want = brute([(*r, None if r[1] is None else len(r[1])) for r in rows])
    got = [tuple(r) for r in op.manifest(make_docs(rows, (*clash, "h", "pos", "n", "key", "tie")), bits=2).collect()]  # many levels of blocks
    assert sorted(got, key=str) == want
    assert {r[-1] for r in got} == {True, False}


def test_small_tables(make_docs):
    assert op.manifest(make_docs([])).collect() == []
    for rows in ([(3, "one")], [(3, "one"), (4, None)], [(1, "a", "x", "s"), (2, "b", "y", "s"), (3, "c", "z", "s")]):
        full = [(*(r if len(r) == 4 else (*r, "en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        assert sorted((tuple(r) for r in op.manifest(make_docs(rows)).collect()), key=str) == brute(full)


def test_largest_count_is_tampered_with(make_docs):
    from pyspark.sql import functions as F

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0]
    docs = make_docs([(i, "x") for i in ids]).withColumn("n_chars", F.lit((1 << 63) - 1))
    assert [r.verified for r in op.manifest(docs).collect()] == [False] * len(ids)


def test_query_equals_its_sql(spark, sf_dir, duck):
    assert rows_of(op.query(spark, sf_dir).toPandas()) == rows_of(duck.sql(op.SQL).df())
