"""Text sources and sinks: gain files, scan definitions, statistics and sky catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GAIN = r"^\s*gain\.(g\d\d)\.(\d+)\.(\d+)\s*=\s*\[\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*\]"


def parsed_gains(lines: DataFrame) -> DataFrame:
    """kind, antenna, beam, re, im of the lines (value) that are gains."""
    c = F.col("value")
    part = lambda i: F.regexp_extract(c, _GAIN, i)
    return lines.where(c.rlike(_GAIN)).select(part(1).alias("kind"), part(2).cast("int").alias("antenna"), part(3).cast("int").alias("beam"), part(4).cast("double").alias("re"), part(5).cast("double").alias("im"))


def read_gains(spark: SparkSession, path: str) -> DataFrame:
    return parsed_gains(spark.read.text(path))


def gain_lines(gains: DataFrame) -> DataFrame:
    return gains.select(F.format_string("gain.%s.%d.%d = [%.9f,%.9f]", "kind", "antenna", "beam", "re", "im").alias("value"))


def write_gains(gains: DataFrame, path: str) -> None:
    gain_lines(gains).write.text(path)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """scan, start_s, end_s of lines "scan start end" in days; a negative scan is an error when it is met."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*-?\d+\s+\S+\s+\S+"))
    scan = c[0].cast("int")
    return rows.select(F.when(scan >= 0, scan).otherwise(F.raise_error(F.lit("a scan number is negative")).cast("int")).alias("scan"), (c[1].cast("double") * 86400).alias("start_s"), (c[2].cast("double") * 86400).alias("end_s"))


def write_statistics(stats: DataFrame, path: str) -> None:
    """Fixed-width rows of channel statistics, five decimals."""
    names = ["rms", "std", "mean", "onepc", "median", "madfm", "max", "min"]
    stats.select(F.format_string("%8d %15.6f" + " %10.5f" * len(names), "chan", "freq", *names).alias("value")).write.text(path)


#: Columns and units of the table of statistics that goes beside an image.
STATISTICS = {"Channel": ("chan", ""), "Frequency": ("freq", "MHz"), "Mean": ("mean", "mJy/beam"), "Std": ("std", "mJy/beam"), "Median": ("median", "mJy/beam"), "MADFM": ("madfm", "mJy/beam"), "1%ile": ("onepc", "mJy/beam"), "Min": ("min", "mJy/beam"), "Max": ("max", "mJy/beam"), "rms": ("rms", "mJy/beam")}


def statistics_table(stats: DataFrame) -> DataFrame:
    """Channel statistics (Hz, Jy) under the names and in the units of STATISTICS; units are kept as column metadata."""
    scale = {"MHz": 1e-6, "mJy/beam": 1e3, "": None}
    return stats.select(*[(F.col(c) if scale[u] is None else F.col(c) * scale[u]).alias(n, metadata={"unit": u}) for n, (c, u) in STATISTICS.items()])


def write_statistics_table(stats: DataFrame, image: str) -> None:
    """The table as part of a stored image: Parquet under its path."""
    statistics_table(stats).write.mode("overwrite").parquet(f"{image.rstrip('/')}/_ImgStats")


def sky_catalogue(components: DataFrame) -> DataFrame:
    """Type, Long, Lat, Annotation, Flux; an empty label becomes the component's number."""
    label = F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.col("number").cast("string")).otherwise(F.col("label"))
    return components.select(F.lit("Component").alias("Type"), F.degrees("ra").alias("Long"), F.degrees("dec").alias("Lat"), label.alias("Annotation"), F.col("flux").alias("Flux"))
