"""As-of, range, interval and tolerance joins.

The calibration side is small per antenna but not bounded in time. What has at
most SMALL rows, which are counted, goes to the tasks as sorted arrays: samples
find their row by binary search where they lie, without a shuffle. Beyond that
both sides are laid into sequences in buckets of time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O  # noqa: E741

#: Seconds of a bucket of time, within which rows of one key are ordered in one task.
BUCKET = 86400.0
#: Rows of a side that goes to the tasks whole.
SMALL = 100_000


def _few(rows: DataFrame, limit: int) -> pa.Table | None:
    """The rows, if there are no more than the limit."""
    out = rows.limit(limit + 1).toArrow() if limit else None
    return out if out is not None and out.num_rows <= limit else None


def _by_key(table: pa.Table, n_keys: int) -> dict[tuple, np.ndarray]:
    """Row numbers of each key, the first n_keys columns."""
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[c.to_pylist() for c in table.columns[:n_keys]], strict=True) if n_keys else [()] * table.num_rows):
        found.setdefault(key, []).append(i)
    return {k: np.array(v) for k, v in found.items()}


def _finder(places: dict[tuple, tuple[np.ndarray, np.ndarray]], side: str):
    """A column function of a time and keys: the number that belongs to the last place at or before the time (side right) or the first at or after it (side left)."""

    def find(time: pa.Array, *keys: pa.Array) -> pa.Array:
        t = time.to_numpy(zero_copy_only=False).astype(float)
        out = np.full(len(t), -1, np.int64)
        code, names = np.zeros(len(t), np.int64), [()]
        for k in keys:
            d = k.dictionary_encode(null_encoding="encode")
            values = d.dictionary.to_pylist()
            code = code * max(1, len(values)) + d.indices.to_numpy(zero_copy_only=False)
            names = [(*n, v) for n in names for v in values]
        for c in np.unique(code):
            if (own := places.get(names[c])) is not None:
                rows = np.flatnonzero(code == c)
                at = np.searchsorted(own[0], t[rows], side) - (side == "right")
                ok = (at >= 0) & (at < len(own[0])) & ~np.isnan(t[rows])
                out[rows[ok]] = own[1][at[ok]]
        return pa.array(out, mask=out < 0)

    return F.arrow_udf(find, "long")


def _asof_few(left: DataFrame, table: pa.Table, by: dict[str, str], left_time: str, columns: list[str], name: str, forward: bool) -> DataFrame:
    """asof against a right side (keys, columns, time) of few rows: a search where the samples lie, then a join by number."""
    n = len(by)
    time = table.column(n + len(columns)).to_numpy().astype(float)
    places = {}
    for key, rows in _by_key(table, n).items():
        order = rows[np.argsort(time[rows], kind="stable")]
        places[key] = (time[order], order)
    spark = left.sparkSession
    payload = table.select(list(range(n, table.num_columns))).rename_columns([f"_p{i}" for i in range(len(columns) + 1)]).append_column("_at", pa.array(np.arange(table.num_rows)))
    find = _finder(places, "left" if forward else "right")
    out = left.withColumn("_at", find(F.col(left_time).cast("double"), *[F.col(k) for k in by]))
    if table.num_rows:
        out = out.join(F.broadcast(spark.createDataFrame(payload)), "_at", "left")
    else:
        out = out.withColumns({f"_p{i}": F.lit(None) for i in range(len(columns) + 1)})
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"_p{i}").alias(c) for i, c in enumerate([*columns, name])])


def asof(left: DataFrame, right: DataFrame, by: dict[str, str], left_time: str, right_time: str, columns: list[str], forward: bool = False, bucket: float = BUCKET, small: int = SMALL) -> DataFrame:
    """left with the columns (and time) of the last row of right at or before its time; null if there is none.

    Both sides are laid into one sequence per key and bucket of time and the last
    right row is carried over, across buckets by a row each: one shuffle of the
    rows, no fan-out, state of one row, and no task has more than a key's
    bucket. With forward it is the first right row at or after the time. A right
    side of at most small rows is searched instead, without any shuffle.
    """
    keys = list(by)
    right = right.where(F.col(right_time).isNotNull())
    if (few := _few(right.select(*[F.col(by[k]).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.col(right_time).alias("_time")), small)) is not None:
        return _asof_few(left, few, by, left_time, columns, right_time if right_time not in left.columns else f"{right_time}_r", forward)
    sign = -1.0 if forward else 1.0
    payload = F.struct(*[F.col(c) for c in columns], F.col(right_time).alias("_time"))
    side = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (sign * F.col(left_time)).cast("double").alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"))
    other = right.select(*[F.col(by[k]).alias(f"_k{i}") for i, k in enumerate(keys)], (sign * F.col(right_time)).cast("double").alias("_t"), F.lit(0).alias("_s"), payload.alias("_r"))
    both = side.unionByName(other, allowMissingColumns=True)
    found = O.last_seen(both, [f"_k{i}" for i in range(len(keys))], ["_t", "_s"], F.floor(F.col("_t") / bucket), F.col("_r"), "_f").where("_s = 1")
    return found.select("_l.*", *[F.when(F.col("_l")[left_time].isNotNull(), F.col(f"_f.{c}")).alias(c) for c in columns], F.when(F.col("_l")[left_time].isNotNull(), F.col("_f._time")).alias(right_time if right_time not in left.columns else f"{right_time}_r"))


def _pieces(starts: np.ndarray, ends: np.ndarray, values: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, row numbers or -1): from each time on (until the next) the interval of least value that is open, both bounds included."""
    order = rows[np.argsort(starts[rows], kind="stable")]
    after = np.nextafter(ends, np.inf)
    times, held, heap, i = [], [], [], 0
    for t in np.unique(np.concatenate([starts[rows], after[rows]])):
        while i < len(order) and starts[order[i]] <= t:
            heapq.heappush(heap, (values[order[i]], int(order[i])))
            i += 1
        while heap and after[heap[0][1]] <= t:
            heapq.heappop(heap)
        times.append(t)
        held.append(heap[0][1] if heap else -1)
    return np.array(times), np.array(held, np.int64)


def first_interval(left: DataFrame, intervals: DataFrame, time: str, keys: list[str], start: str, end: str, value: str, bucket: float = BUCKET, small: int = SMALL) -> DataFrame:
    """left with value of the first interval (by its value) of its keys that holds the time, bounds included; else null.

    At most small intervals are swept into pieces that know their first interval,
    and rows find their piece where they lie. More are dealt out to those buckets
    of time that rows have (an open end reaches no others) and cut there, at each
    other's bounds, into such pieces: one shuffle of the rows by keys and bucket,
    and bounds meet intervals within a bucket only.
    """
    at = lambda x: F.floor(x / bucket)
    i = intervals.select(*keys, F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_z"), F.col(value).alias("_v")).where("_a <= _z")
    if (few := _few(i.where("_v IS NOT NULL"), small)) is not None:
        n = len(keys)
        a, z = (few.column(n + k).to_numpy().astype(float) for k in (0, 1))
        places = {k: _pieces(a, z, few.column(n + 2).to_pylist(), rows) for k, rows in _by_key(few, n).items()}
        found = left.withColumn("_at", _finder(places, "right")(F.col(time).cast("double"), *[F.col(k) for k in keys]))
        if not few.num_rows:
            return left.withColumn(value, F.lit(None).cast(dict(intervals.dtypes)[value]))
        named = left.sparkSession.createDataFrame(pa.table({"_at": np.arange(few.num_rows), "_v": few.column(n + 2)}))
        return found.join(F.broadcast(named), "_at", "left").select(*[F.col(c) for c in left.columns], F.col("_v").alias(value))
    there = left.select(*[F.col(k).alias(f"_l{n}") for n, k in enumerate(keys)], at(F.col(time).cast("double")).alias("_b")).where("_b IS NOT NULL").distinct()
    meets = F.col("_b").between(at(F.col("_a")), at(F.col("_z")))
    for n, k in enumerate(keys):
        meets &= F.col(k).eqNullSafe(F.col(f"_l{n}"))
    i = i.join(there, meets).drop(*[f"_l{n}" for n in range(len(keys))])
    # a bound is a piece of its own (before the rows at that time), and so is what follows it (after them)
    first, last = F.greatest(F.col("_a"), F.col("_b") * bucket), F.col("_z")
    edges = i.select(*keys, "_b", F.explode(F.array(first, last)).alias("_t")).where(at(F.col("_t")) == F.col("_b")).distinct().select(*keys, "_b", "_t", F.explode(F.array(F.lit(0), F.lit(2))).alias("_s"))
    own = i.withColumnsRenamed({k: f"_i_{k}" for k in keys} | {"_b": "_ib"})
    cond = F.col("_b") == F.col("_ib")
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"_i_{k}"))
    inside = (F.col("_a") <= F.col("_t")) & F.when(F.col("_s") == 2, F.col("_z") > F.col("_t")).otherwise(F.col("_z") >= F.col("_t"))
    pieces = edges.join(own, cond & inside, "left").groupBy(*keys, "_b", "_t", "_s").agg(F.struct(F.min("_v").alias("v")).alias("_r"))
    rows = left.select(*keys, at(F.col(time).cast("double")).alias("_b"), F.col(time).cast("double").alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"))
    both = rows.unionByName(pieces, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_f", F.last("_r", ignorenulls=True).over(w)).where("_s = 1").select("_l.*", F.when(F.col("_t").isNotNull(), F.col("_f.v")).alias(value))


def time_clusters(times: DataFrame, tolerance: float, bucket: float = BUCKET) -> DataFrame:
    """time_s, cluster: the first time of the run of times of which each is within tolerance of the one before."""
    t = O.previous(times.select("time_s").distinct(), [], ["time_s"], F.floor(F.col("time_s") / bucket), ["time_s"])
    begins = F.when(F.col("_prev").isNull() | (F.col("time_s") - F.col("_prev.time_s") > tolerance), F.col("time_s"))
    return O.last_seen(t.withColumn("_begins", begins).drop("_prev"), [], ["time_s"], F.floor(F.col("time_s") / bucket), F.col("_begins"), "cluster").select("time_s", "cluster")


def merge_channels(parts: list[DataFrame], n_chans: list[int], keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """Tables side by side in frequency: (time_s, keys, chan) with data or, where a table lacks the row, 0 and flagged.

    Times of all tables that follow each other within tolerance are one
    integration, at the first of them. The frame is the union of all tables'
    rows; each table fills its block of channels.
    """
    offset, data, times = 0, None, None
    for df, n in zip(parts, n_chans, strict=True):
        one = df.select("time_s", *keys, (F.col("chan") + offset).alias("chan"), "re", "im", "flag")
        data, times = (one, one.select("time_s")) if data is None else (data.unionByName(one), times.unionByName(one.select("time_s")))
        offset += n
    data = data.join(time_clusters(times, tolerance), "time_s").withColumn("time_s", F.col("cluster"))
    data = data.groupBy("time_s", *keys, "chan").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.min("flag").alias("flag"))
    # a row's channels come together, then each channel of the frame finds its own
    cells = data.groupBy("time_s", *keys).agg(F.map_from_entries(F.collect_list(F.struct("chan", F.struct("re", "im", "flag")))).alias("_m"))
    out = cells.withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(offset - 1)))).withColumn("_c", F.col("_m")[F.col("chan")])
    return out.select("time_s", *keys, "chan", F.coalesce("_c.re", F.lit(0.0)).alias("re"), F.coalesce("_c.im", F.lit(0.0)).alias("im"), F.coalesce("_c.flag", F.lit(True)).alias("flag"))


def both_antennas(vis: DataFrame, gains: DataFrame, extra: list[str] = (), columns: dict[str, tuple[str, str]] | None = None, how: str = "left") -> DataFrame:
    """Gains joined for antenna1 and antenna2: columns maps a gain column to its two new names."""
    columns = columns or {"g_re": ("g1_re", "g2_re"), "g_im": ("g1_im", "g2_im")}
    for i, antenna in enumerate(("antenna1", "antenna2")):
        side = gains.select(F.col("antenna").alias(antenna), *extra, *[F.col(c).alias(n[i]) for c, n in columns.items()])
        vis = vis.join(side, [antenna, *extra], how)
    return vis


def matched(expr: Column, name: str) -> Column:
    return F.count_if(expr).alias(name)
