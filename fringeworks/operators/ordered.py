"""Ordered operators over keys that may be hot: windows inside buckets of the order, and one row a bucket carried over the borders.

A plain window over a key is one task, whatever its rows. Here the rows of a key
are cut into buckets of its ordering column (a day of time, a block of ids), each
a window of its own; what a bucket needs of the ones before it comes from a
table of one row a bucket, which is small enough to be ordered by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _met(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys; of ends come the other columns."""
    named = ends.withColumnsRenamed({k: f"_e{i}" for i, k in enumerate(keys)})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)])
    return rows.join(named, cond, "left").drop(*[f"_e{i}" for i in range(len(keys))])


def _windows(by: list[str], order: list[str]):
    return Window.partitionBy(*by, "_bucket").orderBy(*order), Window.partitionBy(*by).orderBy("_bucket")


def last_seen(rows: DataFrame, by: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds name: the last value that is not null, up to and with this row."""
    inside, along = _windows(by, order)
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    ends = rows.groupBy(*by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    ends = ends.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return _met(rows, ends, [*by, "_bucket"]).withColumn(name, F.coalesce("_own", "_before")).drop("_bucket", "_value", "_own", "_before")


def previous(rows: DataFrame, by: list[str], order: list[str], bucket: Column, columns: list[str], name: str = "_prev") -> DataFrame:
    """Adds name: the columns of the row before as a struct; null for the first."""
    inside, along = _windows(by, order)
    rows = rows.withColumn("_bucket", bucket)
    one = F.struct(*columns)
    ends = rows.groupBy(*by, "_bucket").agg(F.max_by(one, F.struct(*order)).alias("_last")).select(*by, "_bucket", F.lag("_last").over(along).alias("_before"))
    rows = rows.withColumn("_own", F.lag(one).over(inside))
    return _met(rows, ends, [*by, "_bucket"]).withColumn(name, F.coalesce("_own", "_before")).drop("_bucket", "_own", "_before")


def running_sum(rows: DataFrame, by: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value up to and with this row."""
    inside, along = _windows(by, order)
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    ends = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_all"))
    ends = ends.select(*by, "_bucket", F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.withColumn("_own", F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return _met(rows, ends, [*by, "_bucket"]).withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_bucket", "_value", "_own", "_before")


def islands(rows: DataFrame, by: list[str], order: list[str], bucket: Column, breaks: list[tuple[str, float | None]]) -> DataFrame:
    """Adds island (from 1): consecutive rows per group until a column changes (None) or steps by more than the limit."""
    rows = previous(rows, by, order, bucket, [c for c, _ in breaks])
    cut = F.col("_prev").isNull()
    for c, limit in breaks:
        before = F.col(f"_prev.{c}")
        cut |= ~F.col(c).eqNullSafe(before) if limit is None else F.abs(F.col(c) - before) > limit
    return running_sum(rows, by, order, bucket, F.coalesce(cut, F.lit(True)).cast("int"), "island").withColumn("island", F.col("island").cast("int")).drop("_prev")
