"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the
columns of documents; n_chars follows the text. Labels are read from sf_dir.
Other tables are not needed. Null texts count as empty; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.llm import op01_line_dedup, op03_ngram_jaccard, op06_suffix_dedup, op08_packing, op10_quality_crf
from fringeworks.llm.common import Scratch, documents, tokenizer_path, tune


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed with the columns of docs, n_chars of the new text, and without texts that lost everything."""
    had = [c for c in docs.columns]
    if "n_chars" in had:
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*had)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling random field predicts to be good stay."""
    tune(spark)
    model = op10_quality_crf.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(op10_quality_crf.score_column(model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document that loses every line goes with them."""
    tune(spark)
    out = op01_line_dedup.dedup_lines(docs)
    return _like(docs, out.where((F.col("_fw_removed") == 0) | (F.trim("text") != "")))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays."""
    tune(spark)
    return op03_ngram_jaccard.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document has go; a document that loses all of them goes too."""
    tune(spark)
    out = op06_suffix_dedup.dedup_bytes(docs.withColumn("_fw_had", F.length("text") > 0))
    return _like(docs, out.where(~F.coalesce("_fw_had", F.lit(False)) | (F.col("text") != "")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    tune(spark)
    return op08_packing.pack_documents(docs, tokenizer_path(op08_packing.VOCABULARY))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("jaccard", jaccard), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: No stage before packing but line dedup can be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            scratch.drop(before)
    return docs
