import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fringeworks.llm import op03_ngram_jaccard as op


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    index, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        for e, k in Counter(e for s in sets[d] for e in index[s]).items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            index[s].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def fixture(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [rnd.choice(vocab) for _ in range(60)]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        return w

    rows = [(i, " ".join(edit(base, rnd.randint(0, 3)))) for i in range(120)]
    rows += [(1000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12)))) for i in range(50)]
    rows += [(2000 + i, " ".join(base[:30] + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 40))])) for i in range(60)]
    walk = base
    for i in range(12):
        walk = edit(walk, 1)
        rows.append((3000 + i, " ".join(walk)))
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "One"), (4004, "one"), (4005, "É é"), (4006, "é é"), (4007, " ".join(f"v{i}" for i in range(30_000))), (4008, " ".join(f"v{i}" for i in range(26_000)))]
    return rows


@pytest.mark.parametrize("limits", [None, {"FREQUENT": 2}, {"FREQUENT": 1 << 40, "CROWD": 3}])
def test_same_components_as_brute_force(make_docs, clash, monkeypatch, limits):
    """Frequent from two on, combinations carry the join; or no token is frequent until its bucket shows it."""
    for name, value in (limits or {}).items():
        monkeypatch.setattr(op, name, value)
    rows = fixture(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.document_components(make_docs(rows, clash)).collect()}
    assert got == brute(rows)


def test_repeats_null_ids_and_empty_tables(make_docs):
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (7, "z y x w v u"), (8, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.document_components(make_docs(rows)).collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 4, 5), (None, 4, 5), (7, 2, 7), (8, 0, 8)], key=str)
    assert op.document_components(make_docs([])).collect() == []
    kept = sorted(((r.doc_id, r.text) for r in op.one_of_each(make_docs(rows[:2] + rows[3:])).collect()), key=str)
    assert kept == [(5, "a b c d e f g h"), (7, "z y x w v u"), (8, None)]


def test_similar_sets_share_a_signature():
    """The indexing theorem itself, on random pairs at the threshold, with arbitrary frequent tokens."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 7, 8, 15, 16, 40, 90, 200):
        for _ in range(40):
            m = int(rng.integers(-(-3 * n // 4), 4 * n // 3 + 1))
            need = -(-3 * (n + m) // 7)
            if need > min(n, m):
                continue
            pool = np.unique(rng.integers(0, 2**62, 4 * (n + m)).astype(np.uint64))
            rng.shuffle(pool)
            x, y = pool[:n], np.concatenate([pool[:need], pool[n : n + m - need]])
            share = rng.random()
            is_frequent = lambda t, share=share: (t % np.uint64(1000)) < np.uint64(1000 * share)

            def index(tokens, smaller):
                cls = is_frequent(tokens)
                order = np.lexsort((tokens, cls))
                tokens, rare = tokens[order], int((~cls).sum())
                k = len(tokens)
                prefix = k // 7 + 1 if smaller else k // 4 + 1
                singles, combos = set(tokens[: min(prefix, rare)].tolist()), set()
                if k // 4 + 1 > rare:
                    for part, role in zip(*op.combination_signatures(tokens, rare, k), strict=True):
                        combos |= set((part[role] if smaller else part).tolist())
                return singles, combos

            (a, b), (c, d) = index(x, n < m), index(y, m <= n)
            assert a & c or b & d, (n, m, share)


def test_one_row_of_each_component_and_no_other_text_lost(make_docs, clash):
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    near = t[0] + " x"
    rows = [(1, t[0]), (5, near), (5, t[1]), (6, t[2]), (6, t[3]), (None, t[0]), (None, t[4]), (None, t[4]), (9, t[3]), (7, None), (7, ""), (8, t[1]), (8, t[1])]
    out = op.one_of_each(make_docs(rows, clash))
    assert set(clash) <= set(out.columns)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, t[0]), (5, t[1]), (6, t[2]), (6, t[3]), (None, t[4]), (7, None), (7, "")], key=str)


def test_sets_that_share_a_name_go_by_the_second():
    tokens, n = op.shingle_sets(["a b c d e f", "g h i j k l", None])
    first, second = op.set_ids(tokens, n)
    again, _ = op.set_ids(tokens, n, first[:1])
    assert again.tolist() == [second[0], first[1], 0] and len({*first.tolist(), *second.tolist()}) == 5


def test_texts_are_cut_by_bytes_whole():
    import pyarrow as pa

    from fringeworks.llm.common import pieces

    texts = ["a" * k for k in (3, 0, 50, 2, 2, 2)] + [None, "é" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"]).slice(1)
    got = list(pieces([batch, batch.slice(0, 0)], 1, 6))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts[1:]
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b.column(1).to_pylist()) <= 6 for b in got)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op.query(spark, sf_dir).collect()} == brute(rows)
