import functools
import hashlib
import random

import pytest

from fringeworks.llm import op12_winnowing as op

MASK = (1 << 64) - 1


@functools.cache
def brute_print(text):
    """[(place, hash)] with whole numbers and plain windows."""
    kept = [(i, ord(c) + 32 if "A" <= c <= "Z" else ord(c)) for i, c in enumerate(text) if c not in " \t\n\v\f\r"]
    if not kept:
        return []
    k = min(op.K, len(kept))
    hashes = []
    for i in range(len(kept) - k + 1):
        h = 0
        for _, c in kept[i : i + k]:
            h = (h * op.BASE + c + 1) & MASK
        h ^= h >> 29
        hashes.append((h * 0xBF58476D1CE4E5B9 & MASK) >> 32)
    out = []
    for i in range(max(1, len(hashes) - op.WINDOW + 1)):
        window = list(enumerate(hashes[i : i + op.WINDOW], i))
        least = min(h for _, h in window)
        at = max(j for j, h in window if h == least)
        if not out or out[-1][0] != kept[at][0]:
            out.append((kept[at][0], hashes[at]))
    return out


def told(text):
    return " ".join(f"{p}:{h:08x}" for p, h in brute_print(text))


def jaccard(a, b):
    a, b = {h for _, h in brute_print(a)}, {h for _, h in brute_print(b)}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    texts = [t or "" for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(rows)]
        q = len(t) // 4
        new = t[: len(t) - q] + nxt[:q]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), told(t), told(new), jaccard(t, new), jaccard(t, nxt)))
    return sorted(out, key=str)


def random_text(rnd, n, alphabet="ab cdE\n é日𝒳"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet", ["ab cdE\n é日𝒳", "a", "ab", "xyz \t"])
def test_fingerprint_is_the_definition(alphabet):
    rnd = random.Random(1)
    for n in [*range(0, 60), 100, 333, 1500]:
        t = random_text(rnd, n, alphabet)
        assert op.written(op.fingerprint(t)) == told(t), (n, t[:50])


def test_shared_runs_are_always_found():
    rnd = random.Random(2)
    least = op.WINDOW + op.K - 1
    for _ in range(100):
        run = random_text(rnd, least, "abcdefgh")
        a, b = (random_text(rnd, rnd.randint(0, 300), "ijkl") + run + random_text(rnd, rnd.randint(0, 300), "mnop") for _ in range(2))
        assert set(op.fingerprint(a)[1].tolist()) & set(op.fingerprint(b)[1].tolist())
    t = random_text(rnd, 5000, "abcdefgh")
    places = op.fingerprint(t)[0]
    assert max(places[1:] - places[:-1]) <= op.WINDOW


def test_white_space_and_case_count_for_nothing():
    assert (op.fingerprint("The Thing\nthat was " * 40)[1] == op.fingerprint("thethingthatwas" * 40)[1]).all()


def test_rows(make_docs, clash, spark):
    rnd = random.Random(3)
    rows = [(None, "no id at all, and yet a text"), (-5, "below zero")]
    rows += [(i, rnd.choice([random_text(rnd, rnd.randint(0, 400)), None, "", " \n", "copy " * 30])) for i in range(0, 120)]
    rows += [(500, "w" * 20_000 + random_text(rnd, 3000)), (501, "the last one")]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    docs = make_docs(shuffled, (*clash, "bucket", "end", "o", "t", "size")).repartition(5)
    assert sorted(map(tuple, op.neighbours(docs).collect()), key=str) == brute(rows)


def test_many_buckets(make_docs, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, random_text(rnd, 50)) for i in range(200)]
    monkeypatch.setattr(op, "BUCKET_BYTES", 500)
    assert sorted(map(tuple, op.neighbours(make_docs(rows)).collect()), key=str) == brute(rows)


def test_repeated_ids_and_rows(make_docs, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_BYTES", 200)
    rnd = random.Random(5)
    rows = [(1, "first"), *((7, f"text {i} {random_text(rnd, 60)}") for i in range(100)), *[(7, "same")] * 30, (9, "last")]
    got = op.neighbours(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, told(t)) for d, t in rows)
    following = {hashlib.sha256(op.edited(a, b).encode()).hexdigest() for _, a in rows for _, b in rows}
    assert {r.edited_sha256 for r in got} <= following
    assert sum(r.fingerprint == told("same") and r.near_next == 1.0 for r in got) == 29


def test_small_tables(make_docs):
    assert op.neighbours(make_docs([])).collect() == []
    for rows in ([(1, "alone here")], [(1, None)], [(1, "two of"), (2, "them")]):
        assert sorted(map(tuple, op.neighbours(make_docs(rows)).collect()), key=str) == brute(rows)


def test_operator_by_itself(make_docs):
    rows = [(1, "some text " * 20), (2, None), (2, None)]
    assert sorted(map(tuple, op.fingerprints(make_docs(rows)).collect())) == sorted((d, len(t or ""), told(t or "")) for d, t in rows)


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = op.query(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
