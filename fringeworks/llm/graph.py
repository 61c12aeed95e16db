"""Connected components of a link table by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every id in links (a, b): the label is the smallest id reachable.

    A round takes the least label of all neighbours, then the label of that
    label, so chains halve. Links and labels are tables in the shared folder;
    nothing but whether a label changed reaches the driver. Labels only fall,
    so the rounds end.
    """
    both = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), few=True)
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id"), few=True)
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("id") == F.col("u"), "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("far"))
        new = met.join(jump, F.col("label") == F.col("j"), "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = scratch.save(new, few=True)
        changed = new.where("was <> label").limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "label")
        labels._fw_path = new._fw_path
        if not changed:
            scratch.drop(both)
            return labels
