"""Partitioned Parquet stores of visibilities, image planes and calibration solutions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the driver is the executor."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/") if at else f"file://{tempfile.mkdtemp(prefix='fringeworks-')}"


OPTIONAL = {"sigma_spectrum": "array<double>", "azimuth": "double", "elevation": "double", "polangle": "double"}


def write_vis(vis: DataFrame, path: str, by: tuple[str, ...] = ("scan",), mode: str = "overwrite") -> None:
    """Rows of a partition value go to one writer per shuffle partition; a hot scan spreads over several by AQE's rebalance."""
    vis.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def read_vis(spark: SparkSession, *paths: str) -> DataFrame:
    """Several datasets as one; ms is the path a row came from; optional columns that are absent are null."""
    df = spark.read.parquet(*paths)
    df = df.withColumn("ms", F.regexp_replace(F.input_file_name(), r"/[^/]*=.*$|/part-[^/]*$", ""))
    return df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})


def rank_paths(pattern: str, n: int) -> list[str]:
    """%w in a name stands for the number of a worker."""
    return [pattern.replace("%w", str(i)) for i in range(n)] if "%w" in pattern else [pattern]


def to_wide(vis: DataFrame, keys: list[str]) -> DataFrame:
    """One row per baseline and time with arrays over channels, ordered by channel."""
    cells = F.array_sort(F.collect_list(F.struct("chan", "re", "im", "flag")))
    return vis.groupBy(*keys).agg(cells.alias("c")).select(*keys, F.transform("c", lambda x: F.struct(x.re.alias("re"), x.im.alias("im"))).alias("data"), F.transform("c", lambda x: x.flag).alias("flags"), F.transform("c", lambda x: x.chan).alias("chans"))


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    z = F.arrays_zip("chans", "data", "flags")
    return wide.select(*keys, F.explode(z).alias("z")).select(*keys, F.col("z.chans").alias("chan"), F.col("z.data.re").alias("re"), F.col("z.data.im").alias("im"), F.col("z.flags").alias("flag"))


def write_cube(pixels: DataFrame, path: str) -> None:
    """Pixels (image, chan, pol, x, y, value) as planes, one directory per channel; pixels know their place, so planes may be sparse."""
    planes = pixels.groupBy("image", "pol", "chan").agg(F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("pixels"), (F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    planes.write.mode("overwrite").partitionBy("chan").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("image", "pol", "chan", F.inline("pixels")).select("image", "pol", "chan", "x", "y", "value")


def replaced_partition(new: DataFrame, path: str, by: str) -> None:
    """In-place update: only the partitions that new holds are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
