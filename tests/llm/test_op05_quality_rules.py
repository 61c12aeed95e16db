import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fringeworks.llm import op05_quality_rules as op


def plain(text):
    """The counts, each told in the simplest way."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "é ü 𝒳 #*$ |<>&%\n\nx\nx\n x\nx", "x\n" * 40, "a b c d a b c " * 30, "w\x1cv\x85u\xa0t s"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert op.text_stats(text or "") == plain(text)


def test_counts_of_random_texts():
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("ab \n#é") for _ in range(rnd.randint(0, 120)))
        assert op.text_stats(t) == plain(t)


def by_numpy(rows):
    """The concentration steps group by group, in memory."""
    stats = np.array([plain(r[1]) for r in rows], float)
    n = np.maximum(stats[:, 0], 1)
    failed = (stats[:, 0] < op.MIN_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])
    x = np.stack([np.log(np.maximum(stats[:, 1], 1e-300) / n), *(np.log1p(10 * stats[:, i] / n) for i in (2, 3, 4))], 1)
    levels = []
    for key in (lambda r: (r[2], r[3]), lambda r: r[2], lambda r: 0):
        groups = defaultdict(list)
        for i, r in enumerate(rows):
            if not failed[i]:
                groups[key(r)].append(i)
        levels.append((key, {g: estimate(x[at]) for g, at in groups.items() if len(at) >= op.MIN_GROUP}))
    out = []
    for i, r in enumerate(rows):
        found = next((e[k(r)] for k, e in levels if k(r) in e), None)
        if failed[i]:
            out.append((True, False))
        elif found is None:
            out.append((False, True))
        else:
            d = x[i] - found[0]
            out.append((False, bool(d @ found[1] @ d <= op.LIMIT)))
    return out


def quantile(v, q):
    return np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]


def estimate(x):
    m = np.array([quantile(c, 0.5) for c in x.T])
    s = np.maximum(1.4826 * np.array([quantile(np.abs(c - a), 0.5) for c, a in zip(x.T, m, strict=True)]), op.FLOORS)
    p = np.diag(1 / s**2)
    for _ in range(op.STEPS):
        d = np.einsum("ni,ij,nj->n", x - m, p, x - m)
        y = x[d <= quantile(d, op.SHARE)]
        (m,), (p,) = op.concentrated(np.array([float(len(y))]), y.sum(0)[None], (y.T @ y).reshape(1, -1))
    return m, p


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(260):
        lang, source = (("en", "a"), ("en", "b"), ("de", "a"), ("xx", "rare"), (None, None))[min(4, i % 13 // 3)]
        text = " ".join(word() for _ in range(rnd.randint(40, 90)))
        if i % 17 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, source))
    return rows + [(900, None, "en", "a"), (901, "", None, "a"), (902, "w " * 400, "en", "a"), (903, " ".join(word() for _ in range(60_000)), "en", "a"), (5, rows[5][1], *rows[5][2:])]


def test_verdicts_are_those_of_the_steps_in_memory(make_docs, clash):
    rows = fixture()
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in op.judged(make_docs(rows, clash)).select("doc_id", "base_failed", "kept").collect())
    assert got == sorted((r[0], *v) for r, v in zip(rows, by_numpy(rows), strict=True))
    bad = {r[0] for r in rows if "###" in (r[1] or "")}
    assert not [d for d, _, kept in got if d in bad and kept]


def converged(x):
    """Both beginnings until the determinant falls no further, in memory; the smaller determinant's mean and inverse covariance."""
    h = (len(x) + op.DIM + 1) // 2

    def half(d):
        y = x[d <= np.sort(d)[h - 1]]
        (m,), (p,) = op.concentrated(np.array([float(len(y))]), y.sum(0)[None], (y.T @ y).reshape(1, -1))
        return m, p

    med = np.array([quantile(c, 0.5) for c in x.T])
    s = np.maximum(1.4826 * np.array([quantile(np.abs(c - a), 0.5) for c, a in zip(x.T, med, strict=True)]), op.FLOORS)
    found = []
    for m, p in ((med, np.diag(1 / s**2)), half((np.abs(x - med) / s).max(1))):
        for _ in range(100):
            m, p = half(np.einsum("ni,ij,nj->n", x - m, p, x - m))
        found.append((-np.linalg.slogdet(p)[1], m, p))
    return min(found, key=lambda e: e[0])


@pytest.mark.parametrize("n_bad", [53, 80, 88])
def test_a_third_of_a_group_or_more_are_outliers(make_docs, n_bad):
    rnd = random.Random(n_bad)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows = [(i, " ".join(word() + ("###" if i < n_bad and rnd.random() < 0.8 else "") for _ in range(rnd.randint(60, 90))), "en", "hot") for i in range(n_bad + 100)]
    kept = {r.doc_id: (r.kept, r.distance, r._m, r._p) for r in op.judged(make_docs(rows)).collect()}
    assert not [i for i in range(n_bad) if kept[i][0]]
    assert sum(kept[i][0] for i in range(n_bad, n_bad + 100)) >= 98
    stats = np.array([plain(r[1]) for r in rows], float)
    x = np.stack([np.log(stats[:, 1] / stats[:, 0]), *(np.log1p(10 * stats[:, i] / stats[:, 0]) for i in (2, 3, 4))], 1)
    best, m, p = converged(x)
    assert -np.linalg.slogdet(np.array(kept[0][3]).reshape(4, 4))[1] <= best + 2 * op.TOLERANCE
    assert np.allclose(kept[0][2], m, atol=0.05)


def test_empty_table(make_docs):
    assert op.judged(make_docs([])).collect() == []


def test_query_counts(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_query_keeps_good_documents(spark, sf_dir):
    kept = {r.doc_id: r.kept for r in op.query(spark, sf_dir).where("NOT base_failed").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in kept]
    good = [kept[d] for d, q in labels if q == 1]
    bad = [kept[d] for d, q in labels if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
