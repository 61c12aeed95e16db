import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fringeworks.llm import op08_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
FUZZ = "abcdeXYZ '’s\n\t  12345²½ٱ日本語é𝒳_-!?., "


def checked(rows, docs, n=2048):
    """Pieces cover every document once; sequences are gapless and fit; returns the padding."""
    own = Tokenizer.from_file(PATH)
    want = sorted(((d, own.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs), key=lambda x: str(x[0]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, ids in want:
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= n and len(s) <= op.MAX_SEGMENTS
        padding += 0 if at & (at - 1) == 0 else n - at
    return padding


def test_ids_are_those_of_the_tokenizers_library():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(FUZZ) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a" * 4000, " " * 200 + "x", "<|endoftext|>a <|endoftext|>", "", "\n\n x"]
    a, b = Tokenizer.from_file(PATH), op.tokenizer(PATH)
    assert [x for x in texts if a.encode(x, add_special_tokens=False).ids != b.encode(x)] == []


def test_documents(make_docs, clash):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["the", "of", "thing", "é"]) for _ in range(rnd.choice([0, 1, 5, 300, 2047, 2048, 5000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "word " * 40_000)]
    out = op.pack_documents(make_docs(docs, clash).coalesce(1), PATH).collect()
    assert checked(out, docs) == 0


def test_repeats_null_ids_and_empty_table(make_docs):
    out = op.pack_documents(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in out) == [("1", 0, 3), ("1", 0, 3), ("None", 0, 2)] or sum(r.length for r in out) == 8
    assert op.pack_documents(make_docs([]), PATH).collect() == []


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (2048, 8, 900), (64, 3, 30)])
def test_packer_keeps_all_limits(limits):
    rng = np.random.default_rng(0)
    p, items = op.Packer(*limits), []
    for k in range(1200):
        n = int(rng.exponential(700)) + 1
        items.append((k, n, None if limits[0] == limits[2] else np.concatenate([[0], np.cumsum(rng.random(n) < 0.4)])))
    for a in range(0, 1200, 400):
        p.block(items[a : a + 400])
    p.finish()
    seen, used = defaultdict(int), defaultdict(lambda: np.zeros(3))
    for k, start, n, seq, at in sorted(p.out, key=lambda x: (x[0], x[1])):
        assert start == seen[k]
        seen[k] += n
        s = items[k][2]
        used[seq] += (n, 1, n if s is None else s[start + n] - s[start])
    assert all(seen[k] == n for k, n, _ in items) and all((u <= limits).all() for u in used.values())


def by_hand(items, full):
    """The placements of the rule, example by example: every choice looks at all that wait."""
    full, left, out, wait, cuts = np.array(full, float), np.array(full, float), [], [], 0
    for i, (key, n, sums) in enumerate(items):
        at = 0
        while n - at >= full[0] and sums[at + int(full[0])] - sums[at] <= full[2]:
            at += int(full[0])
        if at < n:
            wait.append([i, key, at, n, sums])
    segments = []
    while wait:
        ask = [(float(n - a), 1.0, float(s[n] - s[a])) for _, _, a, n, s in wait]
        fit = [j for j, d in enumerate(ask) if all(d <= left)]
        if fit:
            j = min(fit, key=lambda j: (-sum(np.array(ask[j]) / full * (left / full)), ask[j], wait[j][0]))
        else:
            j = min(range(len(wait)), key=lambda j: (-ask[j][0], ask[j], wait[j][0]))
        _, key, a, n, s = wait[j]
        size = n - a if fit else max(k for k in range(0, min(n - a, int(left[0])) + 1) if s[a + k] - s[a] <= left[2])
        if size:
            segments.append((key, a, size))
            left = left - (size, 1, s[a + size] - s[a])
            cuts -= 1
            wait[j][0], wait[j][2] = cuts, a + size
            if a + size == n:
                wait.pop(j)
        if not size or left[0] < 1 or left[1] < 1:
            left = full.copy()
    return segments


class Recorded(op.Packer):
    def _place(self, key, start, length, loss):
        self.log = [*getattr(self, "log", []), (key, start, length)]
        super()._place(key, start, length, loss)


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 4, 16), (256, 16, 128)])
def test_choices_are_those_of_the_dot_product_rule(limits):
    """Powers of two as capacities: shares and products are exact."""
    rng = np.random.default_rng(1)
    items = []
    for k in range(150):
        n = int(rng.integers(1, 100))
        items.append((k, n, np.concatenate([[0], np.cumsum(rng.random(n) < 0.3)])))
    p = Recorded(*limits)
    p.block(items)
    p.finish()
    assert p.log == by_hand(items, limits)
    total = defaultdict(int)
    for _, _, n, seq, _ in p.out:
        total[seq] += n
    assert all(t == limits[0] or t & (t - 1) == 0 for t in total.values())


def test_many_short_examples_need_no_padding(make_docs):
    docs = [(i, "a b c") for i in range(500)]
    out = op.pack_documents(make_docs(docs).coalesce(1), PATH).collect()
    assert checked(out, docs) == 0


def test_instruction_data_with_loss_masks(spark):
    rows = [(i, list(range(n)), [k % 3 == 0 for k in range(n)] if i % 2 else None) for i, n in enumerate([5, 2500, 0, 700, 64, 1])]
    df = spark.createDataFrame(rows, "key long, ids array<int>, loss array<boolean>").coalesce(1)
    got = defaultdict(list)
    for r in sorted(op.pack_examples(df, 256, 4, 128).collect(), key=lambda r: (r.key, r.start)):
        got[r.key] += r.ids
    assert dict(got) == {i: x for i, x, _ in rows if x}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op.query(spark, sf_dir).collect()
    assert checked(rows, docs) == 0
