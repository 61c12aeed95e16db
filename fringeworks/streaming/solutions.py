"""Streams of samples: solution intervals as event-time windows, scans as stateful sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def intervals(stream: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of unflagged samples per solution interval; later data than the watermark is dropped by Spark."""
    good = F.col("event_type") != "error"
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(good).alias("n_good"), F.sum(F.when(good, F.col("value"))).alias("total"))


#: Scans that a beam tells at once.
TOLD = 1 << 16
SCANS = "beam int, begin_s double, end_s double, n long, closed boolean, version long"


def scan_sessions(stream: DataFrame, gap_s: float = 1800.0, late: str = "2 hours") -> DataFrame:
    """Scans (SCANS) per beam: a gap or a change of field ends a scan.

    Rows are put in order before they count: those newer than the watermark wait
    in the state. A scan is told as closed once no row can change it any more.
    Each time a beam has news its other scans, as far as they are known, are
    told as open with a higher version; latest_scans() keeps the last word.
    State is the open scan and the rows of the time that late rows may take, which
    are 24 bytes each in Python: time, event and field as arrays of whole numbers.
    """
    import json

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = stream.withWatermark("ts", late).select((F.col("user_id") % 7).cast("int").alias("beam"), F.coalesce((F.col("user_id") % 36 % 3).cast("int"), F.lit(-1)).alias("field"), F.unix_micros("ts").alias("us"), "event_id", "ts")

    def grown(scan, rows):
        """(scans that end: begin, end, n as arrays, the open one) after the ordered rows, an array of us, event_id, field a row."""
        us, field = rows[0], rows[2]
        if not len(us):
            return None, scan
        t = us / 1e6
        cut = np.flatnonzero((np.diff(t) > gap_s) | (np.diff(field) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
        begin, end, n = t[first], t[last - 1], last - first
        if scan and not (t[0] - scan[1] > gap_s or field[0] != scan[3]):
            begin[0], n[0] = scan[0], n[0] + scan[2]
        elif scan:
            begin, end, n = (np.concatenate([[x], y]) for x, y in zip(scan[:3], (begin, end, n), strict=True))
        return (begin[:-1], end[:-1], n[:-1]), [float(begin[-1]), float(end[-1]), int(n[-1]), int(field[-1])]

    def told(beam, ended, closed, version):
        for lo in range(0, len(ended[0]) if ended else 0, TOLD):
            begin, end, n = (x[lo : lo + TOLD] for x in ended)
            yield pd.DataFrame({"beam": beam, "begin_s": begin, "end_s": end, "n": n, "closed": closed, "version": version})

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        scan, version, held = (*json.loads(state.get[0]), state.get[1]) if state.exists else (None, 0, b"")
        parts = [np.frombuffer(held, np.int64).reshape(3, -1)]
        del held
        for pdf in batches:
            parts.append(np.stack([pdf[c].to_numpy(np.int64) for c in ("us", "event_id", "field")]))
        waiting = np.concatenate(parts, axis=1)
        del parts
        waiting = waiting[:, np.lexsort(waiting[::-1])]
        mark = state.getCurrentWatermarkMs() * 1000
        settled = int(np.searchsorted(waiting[0], mark, "right"))
        done, scan = grown(scan, waiting[:, :settled])
        waiting = waiting[:, settled:]
        closed = None
        if scan and scan[1] + gap_s < mark / 1e6 and (not waiting.shape[1] or waiting[0, 0] / 1e6 - scan[1] > gap_s):
            closed, scan = [[x] for x in scan[:3]], None
        version += 1
        state.update((json.dumps((scan, version)), waiting.tobytes()))
        if scan or waiting.shape[1]:
            state.setTimeoutTimestamp(max(int((scan[1] + gap_s if scan else waiting[0, 0] / 1e6) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield from told(key[0], done, True, version)
        yield from told(key[0], closed, True, version)
        later, last = grown(scan, waiting)
        yield from told(key[0], later, False, version)
        yield from told(key[0], [[x] for x in last[:3]] if last else None, False, version)

    return rows.groupBy("beam").applyInPandasWithState(run, SCANS, "held string, waiting binary", "update", GroupStateTimeout.EventTimeTimeout)


def latest_scans(told: DataFrame) -> DataFrame:
    """beam, begin_s, end_s, n: all closed scans, and those that the last version of each beam holds as open."""
    top = told.groupBy(F.col("beam").alias("_beam")).agg(F.max("version").alias("_top"))
    return told.join(top, F.col("beam") == F.col("_beam")).where("closed OR version = _top").select("beam", "begin_s", "end_s", "n").distinct()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is; its batches are written to the shared folder and read as one table.

    In complete mode only the last batch counts, since each holds the whole result.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/batch={0 if mode == 'complete' else n}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/result")
