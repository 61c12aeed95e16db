"""Dotted parameter names: image.x.facet.i.j.taylor.n and gain.g11.antenna.beam."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_image_name(name: str) -> list[Column]:
    """base, facet_x, facet_y, term; parts that are absent are null."""
    c = F.col(name)
    number = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    base = F.regexp_extract(c, r"^(?:image\.)?(.*?)(?:\.facet\.\d+\.\d+)?(?:\.taylor\.\d+)?$", 1)
    return [base.alias("base"), number(r"\.facet\.(\d+)\.\d+").alias("facet_x"), number(r"\.facet\.\d+\.(\d+)").alias("facet_y"), number(r"\.taylor\.(\d+)").alias("term")]


def gain_name(kind: str, antenna: str, beam: str) -> Column:
    return F.concat_ws(".", F.lit("gain"), F.col(kind), F.col(antenna).cast("string"), F.col(beam).cast("string"))
