"""Summaries of visibilities and images: single grouped aggregates with map-side partial sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C_LIGHT
from . import joins as J

SUMMARY = ["n_vis", "max_u", "max_v", "max_w", "min_freq", "max_freq", "n_antennas", "n_beams"]


def summary(vis: DataFrame, use_flagged: bool = False) -> DataFrame:
    """Counts and extents; u, v, w are in wavelengths already."""
    rows = vis if use_flagged else vis.where(~F.col("flag"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_vis"),
        *[F.max(F.abs(c)).alias(f"max_{c}") for c in "uvw"],
        F.min("freq").alias("min_freq"),
        F.max("freq").alias("max_freq"),
        (F.max(F.greatest("antenna1", "antenna2")) + 1).alias("n_antennas"),
        (F.max(F.greatest("feed1", "feed2")) + 1).alias("n_beams"),
    )


def merged_summaries(parts: DataFrame) -> DataFrame:
    """The summary of all from the summaries of parts."""
    return parts.agg(F.sum("n_vis").alias("n_vis"), *[F.max(c).alias(c) for c in ("max_u", "max_v", "max_w")], F.min("min_freq").alias("min_freq"), *[F.max(c).alias(c) for c in ("max_freq", "n_antennas", "n_beams")])


def advice(stats: DataFrame, dish: float = 12.0) -> DataFrame:
    """Cell size and field of view (degrees) for a summary."""
    wave = F.lit(C_LIGHT) / F.col("min_freq")
    return stats.select((F.degrees(1 / (6 * F.greatest("max_u", "max_v"))) * 3600).alias("cell_arcsec"), F.degrees(1.7 * 1.2 * wave / dish).alias("field_deg"))


#: Accuracy of the first pass of quantiles(): its ranks are right to a share of 1 / ACCURACY.
ACCURACY = 1000
#: Parts by value that a bracket is cut into; only those that hold the quantile are ranked.
PARTS = 4096


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """by and the exact quantiles of value, linear between neighbours as SQL's; nulls and NaN left out.

    A sketch brackets each quantile by values that hold its ranks for certain.
    Values below are counted as one, those inside by PARTS parts, and only the
    part that holds the rank, with the next one, is ranked, as distinct values
    with their numbers. No group is ordered as a whole, nor is a bracket.
    Brackets are counted: up to joins.SMALL go to the tasks, so values meet theirs
    where they lie; else groups are that many, and values are joined by group.
    """
    v = rows.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    wide = 2.0 / ACCURACY
    names = list(shares)
    ends = [F.percentile_approx("_v", [max(0.0, shares[n] - wide), min(1.0, shares[n] + wide)], 4 * ACCURACY).alias(f"_e{i}") for i, n in enumerate(names)]
    low, high = ([F.when((F.col("_n") < 4 * ACCURACY) | F.lit(shares[n] - wide <= 0), F.col("_low")).otherwise(F.col(f"_e{i}")[0]) for i, n in enumerate(names)], [F.when((F.col("_n") < 4 * ACCURACY) | F.lit(shares[n] + wide >= 1), F.col("_high")).otherwise(F.col(f"_e{i}")[1]) for i, n in enumerate(names)])
    bounds = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *ends)
    one = F.array(*[F.struct(F.lit(n).alias("_q"), (F.lit(shares[n]) * (F.col("_n") - 1)).alias("_at"), a.alias("_a"), z.alias("_z")) for n, a, z in zip(names, low, high, strict=True)])
    bounds = bounds.select(*by, F.explode(one).alias("_b")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_b.*")
    if (few := J._few(bounds, J.SMALL)) is not None:
        bounds = F.broadcast(rows.sparkSession.createDataFrame(few, bounds.schema))
    cond = F.lit(True)
    for i, k in enumerate(by):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # nothing above the bracket is needed; all that is below counts as one value, in a part of its own
    width = F.col("_z") - F.col("_a")
    inside = F.least(F.floor(F.nanvl((F.col("_v") - F.col("_a")) / width, F.lit(0.0)) * PARTS), F.lit(PARTS - 1))
    part = F.when(F.col("_v") < F.col("_a"), -1).otherwise(F.when(width > 0, inside).otherwise(0)).cast("int")
    near = v.join(bounds, cond).where("_v <= _z").withColumn("_p", part).withColumn("_v", F.when(F.col("_p") >= 0, F.col("_v")))
    counts = near.groupBy(*by, "_q", "_at", "_p", "_v").agg(F.count(F.lit(1)).alias("_m"))
    floor, rest = F.floor("_at"), F.col("_at") - F.floor("_at")
    w = Window.partitionBy(*by, "_q").orderBy("_p")
    parts = counts.groupBy(*by, "_q", "_at", "_p").agg(F.sum("_m").alias("_c")).withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("_holds", (F.col("_upto") > floor) & (F.col("_upto") - F.col("_c") <= floor)).withColumn("_after", F.lag("_holds", 1, False).over(w))
    held = parts.where("_holds OR _after").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_q").alias("_hq"), F.col("_p").alias("_hp"), (F.col("_upto") - F.col("_c")).alias("_before"))
    w = Window.partitionBy(*by, "_q").orderBy(F.asc_nulls_first("_v"))
    ranked = counts.join(held, cond & (F.col("_q") == F.col("_hq")) & (F.col("_p") == F.col("_hp")))
    ranked = ranked.withColumns({"_last": F.first("_before").over(w) + F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, "_next": F.lead("_v").over(w)})
    hit = ranked.where((F.col("_last") >= floor) & (F.col("_last") - F.col("_m") < floor))
    out = hit.withColumn("_x", F.when((rest > 0) & (F.col("_last") == floor), F.col("_v") + rest * (F.col("_next") - F.col("_v"))).otherwise(F.col("_v")))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == n, F.col("_x"))).alias(n) for n in names])


def image_statistics(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Moments, quantiles and the median deviation from the median, NaN left out."""
    rows = pixels.where(~F.isnan(value))
    v = F.col(value)
    first = rows.groupBy(*by).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("std"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"))
    first = first.join(quantiles(rows, by, v, {"onepc": 0.01, "median": 0.5}), by)
    med = first.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("median").alias("_median"))
    cond = F.lit(True)
    for b in by:
        cond &= F.col(b) == F.col(f"_{b}")
    mad = quantiles(rows.join(med, cond), by, F.abs(v - F.col("_median")), {"madfm": 0.5})
    return first.join(mad, by).select(*by, "rms", "std", "mean", "onepc", "median", "max", "min", "madfm")


def bad_channels(stats: DataFrame, threshold: float) -> DataFrame:
    """ratio = onepc / madfm, its deviation from the median in units of the median deviation, and whether it is bad.

    One row per channel: the two medians are global aggregates joined back.
    """
    s = stats.withColumn("ratio", F.when(F.col("madfm") > 0, F.col("onepc") / F.col("madfm")).otherwise(0.0))
    med = s.agg(F.percentile("ratio", 0.5).alias("med"))
    with_med = s.join(med)
    mad = with_med.agg(F.percentile(F.abs(F.col("ratio") - F.col("med")), 0.5).alias("mad"))
    out = with_med.join(mad).withColumn("significance", F.when(F.col("mad") > 0, (F.col("ratio") - F.col("med")) / F.col("mad")))
    return out.withColumn("bad", F.coalesce(F.abs("significance") > threshold, F.lit(False)))


def valid_antennas(vis: DataFrame, by: list[str]) -> DataFrame:
    """(by, antenna) that occur on an unflagged baseline."""
    return vis.where(~F.col("flag")).select(*by, F.explode(F.array("antenna1", "antenna2")).alias("antenna")).distinct()


def flagged_antennas(vis: DataFrame, by: list[str], n_antennas: int) -> DataFrame:
    groups = vis.select(*by).distinct()
    return groups.withColumn("antenna", F.explode(F.sequence(F.lit(0), F.lit(n_antennas - 1)))).join(valid_antennas(vis, by), [*by, "antenna"], "left_anti")


def mosaic(images: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """Weighted mean of aligned images (x, y, value, weight); pixels under cutoff^2 of the largest weight are null."""
    sums = images.groupBy("x", "y").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))
    top = sums.agg(F.max("weight").alias("_top"))
    return sums.join(top).select("x", "y", F.when(F.col("weight") >= cutoff * cutoff * F.col("_top"), F.col("value")).alias("value"), "weight")


def sensitivity(pixels: DataFrame, cutoff: float, weight: str = "weight") -> DataFrame:
    """1 / sqrt(weight) above the cutoff share of the largest weight, else 0."""
    top = pixels.agg(F.max(weight).alias("_top"))
    return pixels.join(top).withColumn("sensitivity", F.when(F.col(weight) > cutoff * F.col("_top"), 1 / F.sqrt(F.col(weight))).otherwise(0.0)).drop("_top")


def peak(pixels: DataFrame, by: list[str], value: Column, *ties: str) -> DataFrame:
    """Row of the largest value per group; ties go to the smallest of the tie columns."""
    order = F.struct(value.alias("_v"), *[(-F.col(t)).alias(f"_{t}") for t in ties])
    rest = [c for c in pixels.columns if c not in by]
    return pixels.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_top")).select(*by, "_top.*")


def normal_equations(rows: DataFrame, parameters: list[str], value: Column, weight: Column, by: list[str] = ()) -> DataFrame:
    """Upper triangle of A'WA and A'Wb as one aggregate, unpivoted to (by, row_par, col_par, value)."""
    cells = []
    for i, a in enumerate(parameters):
        for b in parameters[i:]:
            cells.append((a, b, F.sum(F.col(a) * F.col(b) * weight)))
        cells.append((a, "b", F.sum(F.col(a) * value * weight)))
    one = rows.groupBy(*by).agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(cells)])
    entries = F.array(*[F.struct(F.lit(a).alias("row_par"), F.lit(b).alias("col_par"), F.col(f"c{i}").alias("value")) for i, (a, b, _) in enumerate(cells)])
    return one.select(*by, F.inline(entries))


def solved(normal: dict[tuple[str, str], float], parameters: list[str]) -> list[float]:
    import numpy as np

    n = len(parameters)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, p in enumerate(parameters):
        b[i] = normal[p, "b"]
        for j, q in enumerate(parameters):
            a[i, j] = normal[(p, q) if (p, q) in normal else (q, p)]
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()


def entropy(pixels: DataFrame, by: list[str]) -> DataFrame:
    """-sum(v log v) / sum(v) + log(number of pixels) over positive pixels."""
    v = F.col("value")
    return pixels.groupBy(*by).agg((-F.sum(v * F.log(v)) / F.sum(v) + F.log(F.count(F.lit(1)).cast("double"))).alias("entropy"))


def emptiness(pixels: DataFrame, by: list[str], prior: float, scale: float) -> DataFrame:
    """scale * sum(log cosh((v - prior) / scale)), in the form that cannot overflow."""
    a = F.abs((F.col("value") - prior) / scale)
    return pixels.groupBy(*by).agg((scale * F.sum(a + F.log1p(F.exp(-2 * a)) - math.log(2))).alias("emptiness"))
