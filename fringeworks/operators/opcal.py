"""Calibration of many beams in chunks: a chunk lasts while every beam stays in its scan.

Scans are intervals of cycles per dataset and beam. What a cycle has is a map of
beams to scans; chunks are its islands over cycles, found over one row a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibrate as K
from . import ordered as O  # noqa: E741


def limited(scans: DataFrame, cycles: int) -> DataFrame:
    """Scans (dataset, beam, scan, first, last in cycles) cut into pieces of so many cycles at most: the same columns, scan as scan.piece."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / cycles).cast("int"))
    cut = scans.withColumn("_p", F.explode(pieces))
    return cut.select("dataset", "beam", F.concat_ws(".", "scan", "_p").alias("scan"), (F.col("first") + F.col("_p") * cycles).alias("first"), F.least(F.col("first") + (F.col("_p") + 1) * cycles - 1, F.col("last")).alias("last"))


def chunks(cycles: DataFrame, scans: DataFrame, bucket: int) -> DataFrame:
    """dataset, cycle, chunk (from 1), beams (map beam -> scan) of distinct cycles (dataset, cycle).

    A beam with several scans at a cycle has the least. Cycles without any scan
    make chunks of their own with an empty map.
    """
    one = cycles.select("dataset", "cycle").distinct()
    met = one.join(scans, "dataset", "left").where("cycle BETWEEN first AND last").groupBy("dataset", "cycle", "beam").agg(F.min("scan").alias("scan"))
    maps = met.groupBy("dataset", "cycle").agg(F.sort_array(F.collect_list(F.struct("beam", "scan"))).alias("pairs"))
    rows = one.join(maps, ["dataset", "cycle"], "left").withColumn("pairs", F.coalesce("pairs", F.array().cast(dict(maps.dtypes)["pairs"])))
    i = O.islands(rows, ["dataset"], ["cycle"], F.floor(F.col("cycle") / bucket), [("pairs", None)])
    return i.select("dataset", "cycle", F.col("island").alias("chunk"), F.map_from_entries("pairs").alias("beams"))


def torn(found: DataFrame) -> DataFrame:
    """dataset, beam, scan, n_chunks of scans that more than one chunk holds: their gains are solved in parts."""
    held = found.select("dataset", "chunk", F.explode("beams").alias("beam", "scan")).distinct()
    return held.groupBy("dataset", "beam", "scan").agg(F.count(F.lit(1)).alias("n_chunks")).where("n_chunks > 1")


def solved(samples: DataFrame, found: DataFrame, weight: Column, antennas: int, reference: int = 0) -> DataFrame:
    """dataset, chunk, beam, scan, antenna, amplitude, phase, valid: gains of every beam's part of a chunk.

    samples (dataset, cycle, beam, antenna1, antenna2, re, im, m_re, m_im, the
    model's) of beams that are in no scan take no part.
    """
    j = samples.join(found, ["dataset", "cycle"]).withColumn("scan", F.element_at("beams", F.col("beam"))).where("scan IS NOT NULL AND antenna1 <> antenna2")
    w = j.withColumn("_w", weight)
    sums = w.groupBy("dataset", "chunk", "beam", "scan", "antenna1", "antenna2").agg(
        F.sum(F.expr("_w * (m_re * re + m_im * im)")).alias("vm_re"), F.sum(F.expr("_w * (m_re * im - m_im * re)")).alias("vm_im"), F.sum(F.expr("_w * (m_re * m_re + m_im * m_im)")).alias("mm_re")
    )
    g = K.phase_referenced(K.solved_gains(sums, ["dataset", "chunk", "beam", "scan"], antennas).withColumnRenamed("valid", "_ok"), reference, ["dataset", "chunk", "beam", "scan"])
    ok = sums.select("dataset", "chunk", "beam", "scan", F.explode(F.array("antenna1", "antenna2")).alias("antenna")).distinct().withColumn("valid", F.lit(True))
    out = g.join(ok, ["dataset", "chunk", "beam", "scan", "antenna"], "left")
    return out.select("dataset", "chunk", "beam", "scan", "antenna", F.hypot("g_re", "g_im").alias("amplitude"), F.atan2("g_im", "g_re").alias("phase"), F.coalesce("valid", F.lit(False)).alias("valid"))
