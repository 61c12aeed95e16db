"""Byte-level BPE encoding and decoding.

A sentencepiece BPE model is serialised straight from a rank vocabulary:
byte-mapped pieces scored by negative rank, identity normalisation. Pre-tokens
are encoded one by one; decoding is the inverse mapping of the pieces.

Null and empty texts have no ids and decode to nothing. Repeated rows each get
their row; other columns of the input are ignored or, in with_tokens, kept.
The stage is narrow: no shuffle, one row in and one out, a lost task is redone alone.
Very long texts are encoded whole, a few at a time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import codec
from .common import documents, pieces, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def with_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int>: every text's ids."""

    def encode(it):
        own = codec(vocabulary)
        for b in pieces(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text: the inverse of with_ids."""

    def decode(it):
        own = codec(vocabulary)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def run(it):
        own = codec(vocabulary)
        for b in pieces(it, 1):
            rows = [own.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x, _ in rows], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for _, _, x in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path(VOCABULARY))
