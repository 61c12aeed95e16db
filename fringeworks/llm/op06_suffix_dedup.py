"""Suffix-array dedup: prefix doubling over sampled positions.

Bytes go that are covered by a LENGTH-byte string which also starts in a
document with a smaller id. Prefix doubling names the strings at every position
by (name, name at the offset) pairs of growing length and sorts, until a name
is unique or long enough. Doing that for every byte moves some 24 bytes per
byte of text and round, more than a hundred times the budget of disk; so the
same rounds run over sampled positions:

1. Of all SEED-byte strings inside each LENGTH-byte string, the one with the
   least hash names it; neighbours mostly share it, so a run of about 16
   positions has one row. Equal strings have equal seeds, so nothing is missed.
2. Rows are sorted by seed, then by the name of the doubled length, the whole
   stretch of the run's strings. A seed of one document is unique: it is
   dropped. A stretch that a smaller document has is covered in full.
3. Of runs whose seed is shared, but not the whole stretch, each half is ranked
   by the HALF bytes from or up to its seed that all its strings hold; halves
   unique to a document are dropped.
4. What is left is ranked by every LENGTH-byte string.

Names are hashed locally, since doubling a hash needs no sort; Spark sorts what
must be compared. Sorted rows stream through the tasks: state is one
document's rows of one seed, whatever the size of a group. Finished tables are
written to the shared folder, so that shuffles can be freed.

A passage that a large share of all documents hold would send all its rows to
one task. Seeds that are so frequent in one of SAMPLE documents that they would
fill a quarter of a task are dealt out by seed, stretch and document; each of
their tasks then knows a part of the group only, so it covers what it can and
passes its smallest rows on as tied. The last step ranks such rows once more,
now few, each string in one task. The sample decides where rows go, nothing else.

Null texts are empty. A null doc_id is smaller than any other. Rows with equal
doc_id never remove from each other; rows that repeat a document get the same
result. Texts under LENGTH bytes never change. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, pieces

LENGTH, SEED = 50, 20
#: Seeds in a LENGTH-byte string; no run is longer.
REACH = LENGTH - SEED + 1
#: Places before the seed, from which a string belongs to the left half; bytes that all strings of a half hold.
LEFT = REACH // 2
HALF = LENGTH - LEFT
#: One of so many documents tells which names are frequent; rows of a name among them, from which it is, at least.
SAMPLE, LEAST_HOT = 64, 24
#: Bytes hashed at a time: the working arrays stay in the processor's cache.
CHUNK = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
_NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x *= _A
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S32
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names side by side."""
    out = a * _B
    out ^= out >> _S32
    out += b
    return _mix(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def _names(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """2 bytes, and the names of SEED, 16 and 32 bytes, at every position."""
    p1 = data.astype(np.uint64)
    p2 = p1[:-1] | p1[1:] << np.uint64(8)
    p4 = p2[:-2] | p2[2:] << np.uint64(16)
    p8 = p4[:-4] | p4[4:] << np.uint64(32)
    h16 = _pair(p8[:-8], p8[8:])
    n = len(data) - SEED + 1
    return p2, _pair(h16[:n], p4[16 : 16 + n]), h16, _pair(h16[:-16], h16[16:])


def _place_of_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of every width neighbours."""
    at = np.arange(len(h))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        size += step
    return at


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, name of the stretch, text number, first position, positions) of the runs of texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < LENGTH or sizes.max() < LENGTH:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    p2, seeds, h16, h32 = _names(data)
    n = len(data) - LENGTH + 1
    name = _pair(h32[:n], _pair(h16[32 : 32 + n], p2[48 : 48 + n]))
    least = _least(seeds, REACH)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text_of[:n] == text_of[LENGTH - 1 :])
    seed, doc = least[at], text_of[at]
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    long = np.diff(np.append(start, len(at)))
    pieces = -(-long // REACH)
    if pieces.max(initial=1) > 1:
        first = np.repeat(start, pieces)
        k = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        long = np.minimum(np.repeat(long, pieces) - k * REACH, REACH)
        start = first + k * REACH
    lo, hi = at[start], at[start + long - 1]
    begins = np.cumsum(sizes) - sizes
    stretch = _pair(name[lo], name[hi] + long.astype(np.uint64))
    return seed[start], stretch, doc[start], lo - begins[doc[start]], long


def _tag(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) & 0x1FFFFFF


def _span(tag, lo, n):
    """tag (25 bits) | first position (32) | positions - 1 (6): tells apart texts with one doc_id."""
    return tag << 38 | lo << 6 | (n - 1)


def _chunks(texts: list[bytes]):
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _raw(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _positions(it):
    for b in pieces(it, 1):
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), _raw(b.column(1))
        out = [[], [], [], []]
        for first, part in _chunks(texts):
            seed, stretch, doc, lo, n = runs(part)
            if len(seed):
                tags = np.array([_tag(t) for t in part], np.int64)
                for col, x in zip(out, (seed.view(np.int64), stretch.view(np.int64), ids[first + doc], _span(tags[doc], lo, n)), strict=True):
                    col.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["g", "c", "doc", "span"])


class Ranked:
    """Streams rows sorted by (g, c, doc): yields (doc, span, kind), kind 0 covered, 1 still tied.

    A row is covered if a smaller document has its (g, c). The rows of the
    smallest document of each (g, c) are tied if their g has another such
    document; the rows of hot names always are. Kept between batches: such rows of the last g while they are of
    one document, else only those of its last c.
    """

    def __init__(self, hot: np.ndarray | None = None):
        self.hot = np.zeros(0, np.int64) if hot is None else hot
        self.rest = [np.zeros(0, np.int64) for _ in range(4)]
        self.told = np.zeros(0, bool)
        self.tied_g: int | None = None

    def take(self, columns: list[np.ndarray], last: bool = False):
        g, c, d, s = (np.concatenate([a, b]) for a, b in zip(self.rest, columns, strict=True))
        told = np.concatenate([self.told, np.zeros(len(columns[0]), bool)])
        n = len(g)
        if not n:
            return d, s, np.zeros(0, np.int32)
        new_g = np.ones(n, bool)
        new_g[1:] = g[1:] != g[:-1]
        new_c = new_g.copy()
        new_c[1:] |= c[1:] != c[:-1]
        c_at = np.flatnonzero(new_c)
        least = np.repeat(d[c_at], np.diff(np.append(c_at, n)))
        covered = d > least
        g_at = np.flatnonzero(new_g)
        lengths = np.diff(np.append(g_at, n))
        tied = (np.minimum.reduceat(least, g_at) != np.maximum.reduceat(least, g_at)) | np.isin(g[g_at], self.hot)
        if self.tied_g is not None and g[0] == self.tied_g:
            tied[0] = True
        tell = ~covered & np.repeat(tied, lengths) & ~told
        if last:
            keep = np.zeros(n, bool)
        else:
            begin = c_at[-1] if tied[-1] else g_at[-1]
            keep = ~covered
            keep[:begin] = False
            self.tied_g = int(g[-1]) if tied[-1] else None
        self.told = (told | tell)[keep]
        if not last and tied[-1]:  # one row of a told c is enough to know its smallest document
            at = np.flatnonzero(keep)
            keep[at[:-1]] = False
            self.told = self.told[-1:]
        self.rest = [x[keep] for x in (g, c, d, s)]
        out = covered | tell
        return d[out], s[out], np.where(covered[out], 0, 1).astype(np.int32)


def _ranked(hot: np.ndarray):
    def run(it):
        own = Ranked(hot)
        for b in it:
            d, s, kind = own.take([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(kind)], ["doc", "span", "kind"])
        d, s, kind = own.take([np.zeros(0, np.int64)] * 4, last=True)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(kind)], ["doc", "span", "kind"])

    return run


def _windows_of(raw: bytes, spans: list[int]) -> tuple[int, np.ndarray]:
    """(tag, ascending positions) of the strings of the spans that belong to this text."""
    tag = _tag(raw)
    s = np.array([x & 0x3FFFFFFFFF for x in spans if x >> 38 == tag], np.int64)
    n = (s & 63) + 1
    return tag, np.unique(np.repeat((s >> 6) - (np.cumsum(n) - n), n) + np.arange(n.sum()))


def _halves(it):
    """Tied runs cut into halves of one seed, named by the HALF bytes that the half's strings share."""
    for b in pieces(it, 1):
        ids, texts, spans = b.column(0).to_pylist(), _raw(b.column(1)), b.column(2).to_pylist()
        out = [[], [], []]
        for doc, raw, own in zip(ids, texts, spans, strict=True):
            tag, at = _windows_of(raw, own)
            if not len(at):
                continue
            _, seeds, h16, h32 = _names(np.frombuffer(raw, np.uint8))
            seed = _place_of_least(seeds, REACH)[at]
            left = seed - at >= LEFT
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(seed) != 0) | (left[1:] != left[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            start = np.where(left[first], seed[first] - LEFT, seed[first])
            name = _pair(h32[start], h16[start + HALF - 16])
            name ^= left[first].astype(np.uint64)  # a left and a right half are never the same strings
            for col, x in zip(out, (name.view(np.int64), np.full(len(first), doc, np.int64), _span(np.int64(tag), at[first], n)), strict=True):
                col.append(x)
        if out[0]:
            g, d, s = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d), pa.array(d), pa.array(s)], ["g", "c", "doc", "span"])


def _strings(it):
    """Every LENGTH-byte string of the tied runs, named by 128 bits."""
    for b in pieces(it, 1):
        ids, texts, spans = b.column(0).to_pylist(), _raw(b.column(1)), b.column(2).to_pylist()
        for doc, raw, own in zip(ids, texts, spans, strict=True):
            tag, at = _windows_of(raw, own)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[p : p + LENGTH]) for p in part.tolist()]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(len(part), doc, np.int64)), pa.array(_span(np.int64(tag), part, 1))], ["g", "c", "doc", "span"])


def _hot_names(rows: DataFrame) -> list[int]:
    """Names g of rows of the sampled documents that hold a quarter of a task's share of them: at most four a shuffle partition."""
    share = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_HOT)
    top = counts.orderBy(F.desc("k"), "g").limit(share).collect()
    if not top:
        return []
    least = rows.count() / share
    return [r.g for r in top if r.k >= least]


def _sorted(rows: DataFrame, hot: list[int]) -> DataFrame:
    """doc, span, kind of the ranked rows; those of hot names are spread."""
    to = F.col("g")
    if hot:
        part = F.pmod(F.xxhash64("doc"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        to = F.when(to.isin(hot), F.xxhash64("g", "c", part)).otherwise(to)
    return rows.repartition(to).sortWithinPartitions("g", "c", "doc").mapInArrow(_ranked(np.array(hot, np.int64)), "doc long, span long, kind int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def covered_spans(docs: DataFrame) -> DataFrame:
    """doc, spans: the runs of each document that smaller documents cover."""
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs)
    few = scratch.save(keyed.where(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(SAMPLE)) == 0), few=True)
    names = "g long, c long, doc long, span long"

    def of(spans: DataFrame, texts: DataFrame, work) -> DataFrame:
        """work over the texts that have rows, with their spans."""
        spans = spans.groupBy("doc").agg(F.collect_set("span").alias("spans"))
        return texts.join(spans, "doc").select("doc", "text", "spans").mapInArrow(work, names)

    hot = _hot_names(few.mapInArrow(_positions, names))
    ranked = scratch.save(_sorted(keyed.mapInArrow(_positions, names), hot))
    scratch.free()
    tied = ranked.where("kind = 1")
    hot = _hot_names(of(tied, few, _halves))
    halves = scratch.save(_sorted(of(tied, keyed, _halves), hot).select("doc", "span"))
    scratch.free()
    hot = _hot_names(of(halves, few, _strings))
    last = scratch.save(_sorted(of(halves, keyed, _strings), hot))
    scratch.drop(halves)
    scratch.free()
    found = ranked.where("kind = 0").select("doc", "span").unionByName(last.where("kind = 0").select("doc", "span"))
    if hot:
        again = scratch.save(_sorted(of(last.where("kind = 1"), keyed, _strings), []).where("kind = 0").select("doc", "span"), few=True)
        found = found.unionByName(again)
    return found.groupBy("doc").agg(F.collect_set("span").alias("spans"))


def removed_runs(raw: bytes, spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed stretches [from, to) of a text."""
    if not spans:
        return []
    tag = _tag(raw)
    s = np.array(sorted({x & 0x3FFFFFFFFF for x in spans if x >> 38 == tag}), np.int64)
    if not len(s):
        return []
    lo = s >> 6
    hi = np.maximum.accumulate(lo + (s & 63) + LENGTH)
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
    return list(zip(lo[first].tolist(), hi[last].tolist(), strict=True))


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in gone]]
    starts = [*[a for a, _ in gone], len(raw)]
    return b"".join([raw[a:b] for a, b in zip(ends, starts, strict=True)])


def _met(docs: DataFrame) -> DataFrame:
    """docs with _fw_spans."""
    spans = covered_spans(docs).select(F.col("doc").alias("_fw_doc"), F.col("spans").alias("_fw_spans"))
    return docs.join(spans, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("_fw_doc"), "left").drop("_fw_doc")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """docs with the covered bytes taken out of text; a character cut in two goes whole. Null texts stay null."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others, "text").schema.fields)

    def run(it):
        for b in pieces(it, len(others)):
            n, texts = len(others), []
            for text, spans in zip(b.column(len(others)).to_pylist(), b.column(len(others) + 1).to_pylist(), strict=True):
                if spans and text is not None:
                    raw = text.encode("utf-8", "surrogatepass")
                    text = kept_bytes(raw, removed_runs(raw, spans)).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(texts, pa.string())], [*others, "text"])

    return _met(docs).select(*others, "text", "_fw_spans").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(it):
        for b in pieces(it, 1):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = removed_runs(raw, spans)
                kept = kept_bytes(raw, gone) if gone else raw
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in cols[:3]), pa.array(list(cols[3]), pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _met(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "text", "_fw_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
