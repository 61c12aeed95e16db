"""Product-quantisation codes of vectors by exact integer k-means.

A component x counts as floor(4096 x). Vectors are cut into equal parts, each
with a codebook of its own that starts as the parts of the smallest vec_ids.
Each round is one pass over the table: a task assigns its parts and adds up what
each entry got, Spark sums these few rows a task, and only the codebooks
(entries times components, whatever the table's size) reach the driver.

The nearest entry is screened by one float32 matrix product a part. Its error
is bounded: with u = 2**-24 and m terms, in any order of summation,
|fl(x.c) - x.c| <= g |x|.|c|, g = (m + 2) u / (1 - (m + 2) u), the 2 for rounding
x and c themselves; |x|.|c| is at most the product of the norms. Where only one
entry's interval of |c|^2 - 2 x.c reaches the least upper end, that is the
nearest; all entries that overlap it are evaluated again in int64, and ties go
to the lowest index. Sums are exact, so every order of tasks gives the same.

Nulls: vectors that are null or empty or hold null or non-finite components take
no part; null vec_ids come last; null labels are one label. Ties: equal vec_ids
are ordered by vector. Vectors whose length is not that of the smallest vec_id's
can't be cut alike and take no part, nor do any if that length is no multiple of
the number of parts. With fewer vectors than entries codebooks are shorter. Components
beyond 2**28 are computed with Python's integers instead of the screen; results
beyond a long are the greatest long, components beyond 2**80 an error.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Components whose squared distances surely fit a long, at up to 2**6 components a part (16 bits less for more).
SAFE, MOST = 1 << 28, 1 << 80
LONG = (1 << 63) - 1

#: A label with one in so many rows at least is hot; there are no more hot labels than this.
HOT = 1000


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (array<double>) of the rows that take part, but for the length."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<double>").alias("vector"))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64, or Python's integers if one is too large."""
    x = np.floor(vectors * SCALE)
    if not x.size or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    if np.abs(x).max() > MOST:
        raise ValueError(f"components of vectors must stay within 2**80 / {SCALE}")
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    d = x - c
    return (d * d).sum(axis=1)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries (columns) may be nearest to each row of int64 x, by float32 products and intervals around them."""
    u, m = 2.0**-24, x.shape[1] + 2
    g = m * u / (1 - m * u)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    norms = np.sqrt((xf * xf).sum(axis=1))[:, None] * np.sqrt((cf * cf).sum(axis=1))[None, :]
    square = (cf * cf).sum(axis=1)[None, :]
    middle = square - 2 * product
    # 2**-40 covers the float64 roundings of squares, norms and differences many times over
    reach = 2 * g * norms * (1 + 2.0**-40) + 2.0**-40 * (square + 2 * norms)
    return middle - reach <= (middle + reach).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The index of each row's nearest entry, ties to the lowest."""
    if x.dtype == object or c.dtype == object or np.abs(c).max(initial=0) >= SAFE:
        x, c = x.astype(object), c.astype(object)
        return np.array([min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(r, c[j], strict=True)), j)) for r in x], np.int64)
    near = screened(x, c)
    best = near.argmax(axis=1)
    row, entry = np.nonzero(near & (near.sum(axis=1) > 1)[:, None])
    if len(row):  # rows by entries in order: the first of the least distance has the lowest index
        exact = np.full(near.shape, LONG, np.int64)
        exact[row, entry] = distances(x[row], c[entry])
        again = np.unique(row)
        best[again] = exact[again].argmin(axis=1)
    return best


def _vectors(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(books: np.ndarray):
    """Per task: part, entry, place, n, s, what its parts add to each entry."""
    parts, entries, width = books.shape

    def run(it):
        n, s = np.zeros((parts, entries), object), np.zeros((parts, entries, width), object)
        for b in it:
            x = integers(_vectors(b.column(0), parts * width)).reshape(-1, parts, width)
            for p in range(parts):
                at = nearest(x[:, p], books[p])
                for e in np.unique(at):
                    mine = x[at == e, p]
                    n[p, e] += len(mine)
                    s[p, e] += mine.sum(axis=0).astype(object)
        at = np.argwhere(n > 0)
        if len(at):
            p, e, i = (np.concatenate(v) for v in ([np.repeat(at[:, 0], width)], [np.repeat(at[:, 1], width)], [np.tile(np.arange(width), len(at))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array([int(v) for v in n[p, e]], pa.int64()), pa.array([Decimal(int(v)) for v in s[p, e, i]], pa.decimal128(38, 0))],
                ["part", "entry", "place", "n", "s"],
            )

    return run


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks [part, entry, place] after all rounds over kept rows; None if no vector can be cut."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    if not first or len(first[0].vector) % parts:
        return None
    size = len(first[0].vector)
    rows = rows.where(F.size("vector") == size)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    books = integers(np.array([r.vector for r in start])).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_summed(books), "part int, entry int, place int, n long, s decimal(38,0)")
        now = books.astype(object)
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect():
            now[r.part, r.entry, r.place] = int(r.s) // r.n
        books = now if np.abs(now).max() >= SAFE else now.astype(np.int64)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of kept rows."""
    parts, _, width = books.shape

    def run(it):
        for b in it:
            x = integers(_vectors(b.column(2), parts * width)).reshape(-1, parts, width)
            at = np.stack([nearest(x[:, p], books[p]) for p in range(parts)], axis=1)
            exact = object if x.dtype == object or books.dtype == object else np.int64
            error = sum(distances(x[:, p].astype(exact), books[p][at[:, p]].astype(exact)) for p in range(parts))
            code = [bytes(r).hex() for r in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array([min(int(e), LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.where(F.size("vector") == parts * width).mapInArrow(run, "vec_id long, label long, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error added: the errors of equal labels together. Hot labels are few and broadcast, the rest meet by label."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n"))
    rows = codes.count()
    hot = labels.where(F.col("n") * HOT >= rows).select(F.col("label").alias("l"), F.col("label_error").alias("hot_error"))
    cold = labels.where(F.col("n") * HOT < rows).select(F.col("label").alias("l"), "label_error")
    seen = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    done = seen.where(F.col("hot_error").isNotNull()).withColumnRenamed("hot_error", "label_error")
    rest = seen.where(F.col("hot_error").isNull()).drop("hot_error").join(cold, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    return done.unionByName(rest)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = tune(df.sparkSession)
    rows = kept(df, vector)
    books = trained(rows, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = Scratch(spark).save(coded(rows, books))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""far{r} AS MATERIALIZED (
  SELECT row, part, entry, sum((x - c) * (x - c)) AS d FROM parts JOIN book{r} USING (part, place) GROUP BY row, part, entry
), near{r} AS MATERIALIZED (
  SELECT row, part, entry, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, entry) = 1
)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE {floor} END AS c FROM book{r}
  LEFT JOIN (SELECT part, entry, place, sum(x)::HUGEINT AS s, count(*) AS n FROM near{r} JOIN parts USING (row, part) GROUP BY part, entry, place) USING (part, entry, place)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, i // (len(embedding) // {PARTS}) AS part, i % (len(embedding) // {PARTS}) AS place, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM kept, LATERAL (SELECT unnest(range(len(embedding))) AS i)
), book0 AS MATERIALIZED (
  SELECT part, row AS entry, place, x::HUGEINT AS c FROM parts WHERE row < {ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (row)"""


SQL = _sql()
