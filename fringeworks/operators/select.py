"""Row and channel selection, index maps and per-sample weights: all narrow, all pushed towards the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C_LIGHT, separation


def split_rows(vis: DataFrame, begin: float | None = None, end: float | None = None, scans: Iterable[int] = (), fields: Iterable[int] = (), beams: Iterable[int] = ()) -> DataFrame:
    """Rows inside the closed time range, in the given scans, fields and beams (both feeds); an empty set does not filter."""
    keep = F.lit(True)
    if begin is not None:
        keep &= F.col("time_s") >= begin
    if end is not None:
        keep &= F.col("time_s") <= end
    for columns, wanted in ((("scan",), scans), (("field_id",), fields), (("feed1", "feed2"), beams)):
        if wanted := list(wanted):
            for c in columns:
                keep &= F.col(c).isin(wanted)
    return vis.where(keep)


def named_fields(vis: DataFrame, field: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows whose field has one of the names; no known name at all is an error."""
    wanted = field.where(F.col("name").isin(list(names))).select("field_id")
    if not wanted.limit(1).count():
        raise ValueError("none of the field names is known")
    return vis.join(wanted, "field_id", "left_semi")


def cross_correlations(vis: DataFrame) -> DataFrame:
    return vis.where("antenna1 <> antenna2")


def channel_range(vis: DataFrame, first: int, last: int, width: int, n_chan: int) -> DataFrame:
    """Channels first..last, counted from 1; they must lie in the spectrum and make whole groups of width."""
    if not 1 <= first <= last <= n_chan or (last - first + 1) % width:
        raise ValueError("the range must lie in the spectrum and be a multiple of the width")
    return vis.where(F.col("chan").between(first - 1, last - 1)).withColumn("out_chan", F.floor((F.col("chan") - (first - 1)) / width).cast("int"))


def channel_average(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of unflagged samples per group; sigma adds in squares over the count; a group without any is flagged."""
    good = ~F.col("flag")
    n = F.count_if(good)
    return vis.groupBy(*keys).agg(n.alias("n_good"), F.avg(F.when(good, F.col("re"))).alias("re"), F.avg(F.when(good, F.col("im"))).alias("im"), (F.sqrt(F.sum(F.when(good, F.col("sigma") * F.col("sigma")))) / F.when(n > 0, n)).alias("sigma"), (n == 0).alias("flag"))


def all_polarisations_good(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Adds all_good: no polarisation of the row and channel is flagged."""
    return vis.withColumn("all_good", ~F.max("flag").over(Window.partitionBy(*keys)))


def near_pointing(vis: DataFrame, lon: str, lat: str, ref: tuple[float, float], most: float) -> DataFrame:
    return vis.where(separation(lon, lat, F.lit(ref[0]), F.lit(ref[1])) <= most)


def w_plane(w, scale: float, n: int, clip: bool = False) -> Column:
    """Plane of a linear sampling; outside the planes -1 if clip, else an error in the job.

    The bounds are put to w, not to the plane: a filter on the plane is pushed
    down as a copy of all this, and long methods are not compiled.
    """
    x, first = F.col(w) / scale, (n - 1) // 2
    inside = F.abs(x) + 0.5 < (first + 1.0 if n % 2 else F.when(x < 0, first + 1.0).otherwise(n - first + 0.0))
    return F.when(inside, (nearest(x) + first).cast("int")).otherwise(F.lit(-1) if clip else F.raise_error(F.lit("w is outside of the planes")).cast("int"))


def nearest(x: Column) -> Column:
    """The nearest whole number, halves away from zero, as a double: what round gives, without its decimal arithmetic."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def with_uv_cells(df: DataFrame, cell: float, oversample: int, size: int, wavelengths: bool = False, freq: str = "freq") -> DataFrame:
    """Adds iu, iv (nearest cell of size cells) and fracu, fracv (oversampling step 0..oversample-1) for u and v.

    A step below 0 or beyond the last moves to the neighbouring cell. Every
    expression uses its input once or twice only: filters on the cells are
    pushed down as copies of it, and long methods are not compiled.
    """
    out = {}
    for c in "uv":
        s = F.col(c) / cell if wavelengths else F.col(freq) * F.col(c) / (C_LIGHT * cell)
        i = nearest(s)  # halves away from zero
        f = nearest(oversample * (i - s))
        out |= {f"i{c}": (i - F.floor(f / oversample) + size // 2).cast("int"), f"frac{c}": F.pmod(f, F.lit(float(oversample))).cast("int")}
    return df.withColumns(out)


def on_grid(iu: str, iv: str, support: int, nu: int, nv: int) -> Column:
    """Strictly inside by the support on both axes: from support + 1 to n - support - 1, with one use of each cell (see with_uv_cells)."""
    inside = lambda c, n: F.abs(2 * F.col(c).cast("long") - n) <= n - 2 * support - 2
    return inside(iu, nu) & inside(iv, nv)


def taylor_weight(freq: str, ref: float, order: int) -> Column:
    return F.lit(1.0) if order == 0 else F.pow((F.col(freq) - ref) / ref, F.lit(float(order)))


def noise_weight(sigma: str) -> Column:
    return F.when(F.col(sigma) > 0, 1 / (F.col(sigma) * F.col(sigma)))


def keep_cross_polarisations(value: str, pol: str = "pol") -> Column:
    """XY and YX (1, 2) stay, XX and YY become 0."""
    return F.when(F.col(pol).isin(1, 2), F.col(value)).otherwise(0.0)
