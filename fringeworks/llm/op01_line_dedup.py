"""Line dedup: overlapping three-line windows.

A document's lines are its parts between line feeds; lines of white space only
are passed over. Every three consecutive other lines make a window. Windows are
hashed to 128 bits and grouped over the whole corpus; of each group the first
in order of (doc_id, line) stays and the lines of all later ones go, covered
positions merged.

Windows shuffle as 40-byte rows. The groups are counted with partial
aggregation, so a window that a third of all documents share is one row per
map task, and the join that finds the later occurrences is a plain equi-join
that Spark may split or broadcast. Texts move once, to meet their covered lines.

Null texts stay null, with no lines. Texts of under three lines never change.
A null doc_id sorts first. Rows that repeat doc_id and text are one document:
each gets that document's result. Very long texts are cut into lines whole, a few
texts at a time. Empty tables give no rows. Column names
starting with _fw_ are reserved; any other extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, pieces, same

WINDOW = 3


def _filled(text: str) -> tuple[list[str], list[int]]:
    """The lines, and the places of those with anything but white space."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if WORD.search(x)]


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """_id, _th, pos, h1, h2: every window of the rows (_id, _th, _text)."""

    def run(it):
        for b in pieces(it, 2):
            ids, ths, texts = (b.column(i).to_pylist() for i in range(3))
            out = [[], [], [], []]
            hashes = bytearray()
            for doc, th, text in zip(ids, ths, texts, strict=True):
                lines, at = _filled(text)
                n = len(at) - size + 1
                if n < 1:
                    continue
                kept = [lines[i] for i in at]
                out[0] += [doc] * n
                out[1] += [th] * n
                out[2] += range(n)
                for k in range(n):
                    hashes += xxhash.xxh3_128_digest("\n".join(kept[k : k + size]).encode("utf-8", "surrogatepass"))
            h = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["_id", "_th", "pos", "h1", "h2"])

    return docs.select("_id", "_th", "_text").mapInArrow(run, "_id long, _th long, pos int, h1 long, h2 long")


def covered_starts(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """_id, _th, starts: for each document, where windows start that occurred before."""
    spark = docs.sparkSession
    w = Scratch(spark).save(windows(docs, size))
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = w.join(first, (w.h1 == first.g1) & (w.h2 == first.g2)).where(~same(F.struct("_id", "_th", "pos"), F.col("first")))
    return later.groupBy("_id", "_th").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with repeated lines removed from text, and the columns _fw_lines, _fw_removed."""
    key = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.coalesce("text", F.lit("")).alias("_text"))
    starts = covered_starts(key, size)
    starts = starts.select(F.col("_id").alias("_fw_sid"), F.col("_th").alias("_fw_sth"), F.col("starts").alias("_fw_starts"))
    named = docs.withColumns({"_fw_id": F.col("doc_id").cast("long"), "_fw_th": F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = named.join(starts, same(F.col("_fw_id"), F.col("_fw_sid")) & (F.col("_fw_th") == F.col("_fw_sth")), "left")
    others = [c for c in docs.columns if c != "text"]
    joined = joined.select(*others, "text", "_fw_starts")
    schema = joined.drop("_fw_starts")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields] + ["`_fw_lines` long", "`_fw_removed` long"])

    def run(it):
        for b in pieces(it, len(others)):
            n = len(others)
            texts, lines_n, removed = [], [], []
            for text, at in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                if not at:
                    texts.append(text)
                    lines_n.append(0 if text is None else text.count("\n") + 1)
                    removed.append(0)
                    continue
                lines, filled = _filled(text)
                gone = {filled[s + k] for s in at for k in range(size)}
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in gone]))
                lines_n.append(len(lines))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array(lines_n, pa.int64()), pa.array(removed, pa.int64())], [*others, "text", "_fw_lines", "_fw_removed"])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_fw_lines").alias("n_lines"), F.col("_fw_removed").alias("n_removed"), "text")


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
f AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE c IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT later.doc_id, later.pos + x.k AS pos FROM later, (VALUES (0), (1), (2)) AS x(k)),
kept AS (SELECT l.doc_id, l.i, l.line, gone.pos IS NOT NULL AS removed FROM l LEFT JOIN f USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.pos = f.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS text
FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
