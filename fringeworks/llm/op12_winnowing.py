"""Document fingerprints by winnowing, and how alike neighbours and edits are.

Text is reduced to code points without ASCII white space, A-Z in lower case. A
rolling hash covers every K of them (all, if there are fewer). Of each WINDOW
consecutive hashes the least is chosen, the rightmost of equal ones, and kept
with its place in the text: two texts that share WINDOW + K - 1 reduced code
points share a chosen hash, and no run of WINDOW hashes is without one. The
likeness of two fingerprints is the Jaccard similarity of their sets of hashes.

The next document by doc_id is met without a global window: rows go to buckets
of consecutive keys (doc_id, text hash), whose bounds are keys of a bounded
sample weighted by bytes, and each bucket also gets the first text of the next
bucket. Texts move once; a task streams through its sorted bucket and holds two.

Nulls: a null text is empty; null doc_ids count as the smallest long, first in
order. Empty texts (or white space alone) have the empty fingerprint; two of
these are alike (1.0), one and another are not (0.0). Ties: equal doc_ids are
ordered by the hash of their texts, equal rows follow each other. One document
alone is its own next. Very long texts are whole, one at a time. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

K, WINDOW = 12, 32

#: Bytes of text of one bucket; buckets at most; sampled keys a bucket, which bound what the driver gathers.
BUCKET_BYTES, MOST_BUCKETS, SAMPLED = 32 << 20, 100_000, 20

#: Result rows of one Arrow batch hold so many bytes of text.
OUT_BYTES = 4 << 20

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse's powers modulo 2**64 for i < n at least; kept for the next text."""
    if len(_powers[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        for i, b in enumerate((BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def reduced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points that count, and their places in text."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = np.flatnonzero(~((c == 32) | ((c >= 9) & (c <= 13))))
    c = c[at]
    return np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64), at


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """32-bit hashes (as uint64) of every K consecutive values, or of all of them if there are fewer."""
    k = min(K, len(c))
    if not k:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(c))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((c + np.uint64(1)) * inverse[: len(c)], dtype=np.uint64)))
    h = (sums[k:] - sums[:-k]) * power[k - 1 : len(c)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def chosen(h: np.ndarray) -> np.ndarray:
    """Indexes of each window's least hash, rightmost of equal ones, each once, ascending."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    keys = (h << np.uint64(32)) | (_LOW - np.arange(n, dtype=np.uint64))
    if n <= WINDOW:
        least = keys.min(keepdims=True)
    else:  # minima of blocks from the left and from the right: a window is the end of one and the beginning of the next
        full = np.full(-(-n // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
        full[:n] = keys
        full = full.reshape(-1, WINDOW)
        left = np.minimum.accumulate(full, axis=1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: n - WINDOW + 1], left[WINDOW - 1 : n])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (_LOW - (least & _LOW)).astype(np.int64)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in text (code points) and 32-bit hashes."""
    c, at = reduced(text)
    h = gram_hashes(c)
    i = chosen(h)
    return at[i], h[i]


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """place:hash pairs, places decimal, hashes in eight hex digits."""
    at, h = print_
    digits = h.astype(">u4").tobytes().hex()
    return " ".join(f"{p}:{digits[8 * i : 8 * i + 8]}" for i, p in enumerate(at.tolist()))


def likeness(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of the following one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row: no shuffle."""

    def run(it):
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _bounds(keys: DataFrame, parts: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """The first keys of all buckets but the first, ascending, and the smallest key; keys: o, t, size."""
    n, size, least = keys.agg(F.count("*"), F.sum("size"), F.min(F.struct("o", "t"))).first()
    if not n:
        return [], None
    buckets = int(min(n, MOST_BUCKETS, max(parts, -(-size // BUCKET_BYTES))))
    share = min(1.0, SAMPLED * buckets / n)
    seen = (keys if share == 1.0 else keys.sample(share, 12)).toPandas().sort_values(["o", "t"], kind="stable")
    run = seen["size"].cumsum().to_numpy()
    cuts = np.searchsorted(run, np.arange(1, buckets) * (run[-1] / buckets), side="right") if len(run) else []
    first = (least["o"], least["t"])
    return sorted({k for i in cuts if i < len(run) and (k := (int(seen["o"].iloc[i]), int(seen["t"].iloc[i]))) > first}), first


def _bucket_of(bounds: list[tuple[int, int]]):
    """The number of bounds that are not above a key, as a column expression of o and t."""
    o, t = (np.array([k[i] for k in bounds], np.int64) for i in (0, 1))

    def bucket(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
        low, high = np.searchsorted(o, a, "left"), np.searchsorted(o, a, "right")
        for i in np.unique(low[low < high]):  # doc_ids that are bounds: their texts' hashes decide
            rows = np.flatnonzero((low == i) & (high > i))
            low[rows] = i + np.searchsorted(t[i : high[rows[0]]], b[rows], "right")
        return pd.Series(low.astype(np.int32))

    return F.pandas_udf(bucket, "int")


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("o"), F.xxhash64("text").alias("t"))
    scratch = Scratch(spark)
    keys = scratch.save(rows.select("o", "t", F.octet_length("text").cast("long").alias("size")), True)
    bounds, first = _bounds(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch.drop(keys)
    if first is None:
        return rows.limit(0).mapInArrow(_streamed, SCHEMA)
    buckets = len(bounds) + 1
    ends = spark.createDataFrame([(*k, b) for b, k in enumerate([*bounds, first])], "o long, t long, bucket int")
    last = rows.join(F.broadcast(ends), ["o", "t"]).groupBy("bucket").agg(F.first("text").alias("text"))  # one row a bucket, at most MOST_BUCKETS keys
    own = rows.withColumn("bucket", _bucket_of(bounds)("o", "t") if bounds else F.lit(0)).withColumn("end", F.lit(False))
    last = last.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("t"), "bucket", F.lit(True).alias("end"))
    dealt = own.unionByName(last).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "end", "o", "t")
    return dealt.select("doc_id", "text", "end").mapInArrow(_streamed, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _streamed(it):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    out, held, before = [], 0, None  # before: id, text, written fingerprint, its hashes

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names)

    for b in it:
        for row in range(b.num_rows):
            doc_id, text, end = (b.column(i)[row].as_py() for i in range(3))
            if before is not None and before[1] == text:
                now = (doc_id, *before[1:])
            else:
                own = fingerprint(text)
                now = (doc_id, text, written(own), set(own[1].tolist()))
            if before is not None:
                new = edited(before[1], text)
                changed = fingerprint(new)
                out.append((before[0], len(before[1]), hashlib.sha256(new.encode()).hexdigest(), before[2], written(changed), likeness(before[3], set(changed[1].tolist())), likeness(before[3], now[3])))
                held += len(new) + len(before[2])
            before = None if end else now
            if held > OUT_BYTES:
                yield batch()
                out, held = [], 0
    if out:
        yield batch()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
