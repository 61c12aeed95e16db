import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from fringeworks.llm import bytebpe
from fringeworks.llm import op09_byte_bpe as op

PATH = P.path("byte_bpe_multi_50k.tiktoken")
FUZZ = "abcdeXYZ '’s\n\t  12345²½ٱ日本語é𝒳_-!?.,́<|endoftext|>\x1c\x85\xa0"


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(9)
    out = ["".join(rnd.choice(FUZZ) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    return out + ["".join(chr(c) for c in range(0x20, 0x800)), "a" * 5000, " " * 300 + "x", "<|endoftext|>", "", "don't we'll", "日本" * 2000]


def test_pattern_is_the_published_one():
    assert bytebpe.PATTERN == P.PATTERN


def test_encodes_as_tiktoken_and_decodes_back(tik):
    own = bytebpe.codec(PATH)
    for t in texts():
        ids = tik.encode_ordinary(t)
        assert own.encode(t) == ids, t[:60]
        n, joined, raw = own.digest(t)
        assert (n, joined, raw) == (len(ids), ",".join(map(str, ids)).encode(), t.encode())


def test_small_cache_changes_nothing(tik):
    own = bytebpe.Codec(PATH)
    own.CACHE = 5
    assert all(own.digest(t)[0] == len(tik.encode_ordinary(t)) for t in texts()[:200])


def test_pre_tokens_cover_the_text():
    assert all("".join(bytebpe.pre_tokens(t)) == t and bytebpe.pre_tokens(t) == bytebpe._FULL.findall(t) for t in texts())


def test_rows(make_docs, clash, tik):
    docs = [(1, None), (2, ""), (3, "the thing"), (3, "the thing"), (None, "x"), (4, "word " * 60_000)]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.digests(make_docs(docs, clash), PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(d), len(ids := tik.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in docs)
    assert op.digests(make_docs([]), PATH).collect() == []
    ids = op.with_ids(make_docs(docs), PATH)
    assert sorted(map(str, ((r.doc_id, r.text) for r in op.decoded(ids, PATH).collect()))) == sorted(map(str, ((d, t or "") for d, t in docs)))


def test_query(spark, sf_dir, tik):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op.query(spark, sf_dir).collect():
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
