"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows of one Arrow batch, unless the session says otherwise; bytes of text that Python works on at once.
BATCH_ROWS, PIECE_BYTES = 1000, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker holds few texts at a time; a value that the caller set stays."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def pieces(batches, column: int, limit: int = PIECE_BYTES):
    """The batches cut into slices whose texts (a string column) have limit bytes together, or of one row."""
    for b in batches:
        text = b.column(column)
        if not b.num_rows or text.nbytes <= limit:
            yield b
            continue
        size = np.frombuffer(text.buffers()[1], "<i4", b.num_rows + 1, offset=4 * text.offset).astype(np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='fringeworks-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written into the shared folder: they cut lineage and outlive executors.

    drop() deletes one that is no longer needed. The rest serve lazy results:
    release() deletes them when the caller has consumed these, and the end of
    the driver's Python does so at the latest.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fw-{uuid.uuid4().hex}"
        self.n = 0
        if not Scratch.open:
            atexit.register(release)
        Scratch.open.append(self)

    def save(self, df: DataFrame, few: bool = False) -> DataFrame:
        """df as a written table. few: a quarter of the files, for tables much smaller than those they are made from."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        if few:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._fw_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_fw_path", None):
            fs, p = _fs_path(self.spark, path)
            fs.delete(p, True)

    def free(self) -> None:
        """Shuffle files of finished steps go when the driver's collector meets their plans; this asks it to run now."""
        for _ in range(2):  # files go in the background, after the first run has found the plans
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                fs, p = _fs_path(self.spark, self.root)
                fs.delete(p, True)
        except Exception:  # the JVM may be gone already
            pass


def release() -> None:
    """Deletes the tables behind all results so far: for long sessions, once these are written or collected."""
    while Scratch.open:
        Scratch.open.pop().close()


def same(a: Column, b: Column) -> Column:
    """Null-safe equality, usable as a join key."""
    return a.eqNullSafe(b)


def doc_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns _id and _th: a row's identity is its doc_id and the hash of its text.

    Rows that agree in both are the same document repeated, and get the same result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


#: Bits of the number of slots of a membership table: eight slots a key between these bounds.
SLOT_BITS = (16, 28)
_BLOCK = 1 << 15


def slot_bits(keys: int) -> int:
    return min(max((8 * keys).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def slot_table(df: DataFrame, key: str, value: str | None = None, bits: int | None = None) -> np.ndarray:
    """A table of 2**bits bytes: slot key mod 2**bits holds the largest value (1..255) of its keys.

    Keys that share a slot share a value, so a lookup may overstate, never
    understate. What reaches the driver is at most 2**28 bytes at any size of
    df, a table in the shared folder whose rows are counted to choose bits.
    """
    bits = bits or slot_bits(df.count())
    n = 1 << bits
    slots = df.select(F.expr(f"`{key}` & {n - 1}L").alias("s"), (F.lit(1) if value is None else F.col(value)).cast("int").alias("v"))
    slots = slots.groupBy("s").agg(F.max("v").alias("v"))

    def blocks(it):
        import pyarrow as pa

        for batch in it:
            s, v = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            at = s // _BLOCK
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    yield pa.RecordBatch.from_pydict({"b": pa.array([int(at[part[0]])], pa.int64()), "s": pa.array([(s[part] % _BLOCK).astype("<u2").tobytes()], pa.binary()), "v": pa.array([v[part].astype("u1").tobytes()], pa.binary())})

    out = np.zeros(n, "u1")
    for b, s, v in slots.repartition(max(1, min(16, n // _BLOCK // 8)), F.expr(f"s div {_BLOCK}")).mapInArrow(blocks, "b long, s binary, v binary").collect():
        at = b * _BLOCK + np.frombuffer(s, "<u2").astype(np.int64)
        out[at] = np.maximum(out[at], np.frombuffer(v, "u1"))
    return out


def looked_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[keys.view(np.uint64) & np.uint64(len(table) - 1)]


def crc_mod3(column: str) -> Column:
    """crc32 of the decimal text of an id, mod 3."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.environ.get("FRINGEWORKS_TOKENIZERS", "") and os.path.join(os.environ["FRINGEWORKS_TOKENIZERS"], name) or public_tokenizers.path(name)
