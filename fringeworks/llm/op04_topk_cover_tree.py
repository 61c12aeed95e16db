"""Exact top-k search by dual-tree descent of cover trees.

Queries and data are indexed together: a block of data and each batch of the
queries that may have neighbours there become cover trees whose nodes hold a
centre, the points below and a covering radius. A pair of nodes (Q, D) is pruned
when no inner product below it can reach the worst kth score that the queries
of Q have so far: for centres a, b and radii r, s every product is at most
a.b + |a| s + r |b| + r s. Pairs are visited best bound first; at pairs of
leaves all products are computed.

Data fall into cells around centres, far apart, of a bounded sample of the rows,
and cells into blocks. A query's kth best score against the sample is a bound
from below for the true one: it goes before any row moves, so a query is sent
to the cells only whose bound reaches it, and it starts the search in each
block. A data row moves once for every QUERIES queries, its block's tree is
built once, and the queries stream past it. A block leaves at most k rows a
query, the best of their union are the answer.

The sample decides what moves where, never what is found. Vectors are
floor(SCALE * x) in double precision. Whole numbers whose products are exact in
doubles are multiplied there; larger ones at the leaves by Python's integers,
under the same tree and bounds. Scores beyond a long are compared in full and
returned as the long's ends.

Vectors that are null, empty, or hold null or non-finite components, or such
that are not finite when scaled, take no part. Vectors of unlike lengths never
meet. Ties go to the smaller id. Repeated rows are candidates of their own, but
never of a query with the same id. Empty tables give no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, tune

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a block of data, at least and at most; queries that a block's task takes, and at once.
LEAST_BLOCK, MOST_BLOCK, QUERIES, QUERY_BATCH = 2048, 32768, 65536, 1024
#: Leaves of the trees; children of a node, at most.
LEAF, QUERY_LEAF, FAN = 128, 32, 8
#: Rows of the sample for each length of vectors, and cells made from it.
SAMPLE, CELLS = 1024, 64
#: Whole numbers below this have exact products and sums in doubles.
EXACT = 2.0**53
_LONG = 2**63 - 1


class CoverTree:
    """Nodes of shrinking covering radius, every one with the exact radius of its points.

    Centres of children are points taken greedily farthest first, until they
    cover all points within half of the node's radius or FAN are taken. What
    they cover is then the level's radius: every point lies within it of its
    centre, and the centres are at least that far from each other, as a cover
    tree asks; where FAN centres reach less than half way, the next level goes on.
    """

    __slots__ = ("children", "centre", "norm", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int, centre: np.ndarray | None = None):
        self.rows = rows
        points = x[rows]
        self.centre = points[0] if centre is None else centre
        gap = np.sqrt(((points - self.centre) ** 2).sum(1))
        self.radius, self.norm = float(gap.max()), float(np.sqrt((self.centre**2).sum()))
        self.children: list[CoverTree] = []
        if len(rows) <= leaf or self.radius == 0:
            return
        centres, best, owner = [points[0]], np.sqrt(((points - points[0]) ** 2).sum(1)), np.zeros(len(rows), int)
        while best.max() > self.radius / 2 and len(centres) < FAN:
            new = points[int(best.argmax())]
            d = np.sqrt(((points - new) ** 2).sum(1))
            owner[d < best] = len(centres)
            best = np.minimum(best, d)
            centres.append(new)
        if len(centres) > 1:
            self.children = [CoverTree(x, rows[owner == i], leaf, c) for i, c in enumerate(centres) if (owner == i).any()]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products: doubles where these are exact, else Python's integers."""
    if np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1] < EXACT:
        return q @ x.T
    return _whole(q) @ _whole(x).T


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


class Search:
    """The k best of a tree's points x for batches of queries; products counts the pairs multiplied."""

    def __init__(self, x: np.ndarray, x_ids: np.ndarray, k: int):
        self.x, self.ids, self.k, self.products = x, x_ids, k, 0
        self.tree = CoverTree(x, np.arange(len(x)), LEAF) if len(x) else None

    def batch(self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray) -> list[list[tuple]]:
        """Rows (score, id) for each query; none whose score is below floor, which no kth best score is."""
        if self.tree is None or not len(q):
            return [[] for _ in q]
        exact = bool(np.abs(q).max(initial=0.0) * np.abs(self.x).max(initial=0.0) * q.shape[1] < EXACT)
        worst, best = floor.copy(), [[] for _ in q]
        scores = np.full((len(q), self.k), -np.inf) if exact else None
        ids = np.full((len(q), self.k), np.iinfo(np.int64).max) if exact else None

        def bound(a: CoverTree, b: CoverTree) -> float:
            # a hair above, for the rounding of roots and products
            return float(a.centre @ b.centre) + (a.norm * b.radius + a.radius * b.norm + a.radius * b.radius + 1e-9 * a.norm * b.norm) * (1 + 1e-9) + 1e-6

        n, root = 0, CoverTree(q, np.arange(len(q)), QUERY_LEAF)
        heap = [(-bound(root, self.tree), 0, root, self.tree)]
        while heap:
            top, _, a, b = heapq.heappop(heap)
            if -top < worst[a.rows].min():
                continue
            if not a.children and not b.children:
                self.products += len(a.rows) * len(b.rows)
                if exact:
                    s = q[a.rows] @ self.x[b.rows].T
                    s[q_ids[a.rows][:, None] == self.ids[b.rows][None]] = -np.inf
                    alls, alli = np.hstack([scores[a.rows], s]), np.hstack([ids[a.rows], np.broadcast_to(self.ids[b.rows], s.shape)])
                    order = np.lexsort((alli, -alls), axis=1)[:, : self.k]
                    scores[a.rows], ids[a.rows] = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
                    worst[a.rows] = np.maximum(worst[a.rows], scores[a.rows, self.k - 1])
                else:
                    s = _products(q[a.rows], self.x[b.rows])
                    for r, row in zip(a.rows.tolist(), s, strict=True):
                        new = best[r] + [(-int(v), int(i)) for v, i in zip(row, self.ids[b.rows], strict=True) if i != q_ids[r]]
                        best[r] = heapq.nsmallest(self.k, new)
                        if len(best[r]) == self.k:
                            worst[r] = max(worst[r], _below(-best[r][-1][0]))
                continue
            split_a = a.children if a.children and (not b.children or a.radius >= b.radius) else [a]
            split_b = b.children if split_a == [a] else [b]
            for c in split_a:
                for d in split_b:
                    n += 1
                    if (u := bound(c, d)) >= worst[c.rows].min():
                        heapq.heappush(heap, (-u, n, c, d))
        if exact:
            return [[(int(s), int(i)) for s, i in zip(a, b, strict=True) if np.isfinite(s)] for a, b in zip(scores, ids, strict=True)]
        return [[(-s, i) for s, i in rows] for rows in best]


def _below(score: int) -> float:
    """A double that is not above a whole number."""
    try:
        return float(score) - abs(float(score)) * 1e-12
    except OverflowError:
        return -np.inf if score < 0 else np.finfo(float).max


def dual_tree_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[list[list[tuple]], int]:
    """Rows (score, id) of the k best of x for each q, and the number of products computed."""
    search = Search(x, x_ids, k)
    return search.batch(q, q_ids, np.full(len(q), -np.inf)), search.products


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """id, dim, v: whole-numbered vectors of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    df = df.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    # floor() of a double gives a long in Spark; from 2**53 on doubles are whole and stay
    v = F.transform("v", lambda e: F.when(F.abs(e) < EXACT / scale, F.floor(e * scale).cast("double")).otherwise(e * scale))
    return df.select("id", F.size("v").alias("dim"), v.alias("v")).where(~F.exists("v", lambda e: F.abs(e) == float("inf")))


class Cells:
    """Centres of one length of vectors, and the sample that they come from: at most SAMPLE rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int):
        self.ids, self.x = ids, x
        centres, best = [0], ((x - x[0]) ** 2).sum(1)
        while len(centres) < min(n, len(x)) and best.max() > 0:
            centres.append(int(best.argmax()))
            best = np.minimum(best, ((x - x[centres[-1]]) ** 2).sum(1))
        self.centres = x[centres]
        self.norms = np.sqrt((self.centres**2).sum(1))

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((v - c) ** 2).sum(1)) for c in self.centres], 1)

    def floors(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> np.ndarray:
        """A bound from below of each query's kth best score: the kth best in the sample."""
        if len(self.ids) <= k:
            return np.full(len(q), -np.inf)
        s = q @ self.x.T
        s = s - 1e-9 * np.abs(s) - 1e-9 * np.sqrt((q**2).sum(1))[:, None] * np.sqrt((self.x**2).sum(1))[None]
        s[q_ids[:, None] == self.ids[None]] = -np.inf
        return np.partition(s, len(self.ids) - k, axis=1)[:, len(self.ids) - k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column.to_pylist()]) if len(column) else np.zeros((0, dim))


def _by_dim(batch):
    """(dim, rows) of a batch with a column dim second."""
    dims = batch.column(1).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _key(score: int) -> tuple[int, bytes | None]:
    """The score within a long, and bytes in the order of the numbers for those at its ends."""
    if -_LONG < score < _LONG:
        return score, None
    size = abs(score).bit_length() // 8 + 1
    raw = b"\x01" + size.to_bytes(4, "big") + score.to_bytes(size, "big") if score > 0 else b"\x00" + (2**32 - size).to_bytes(4, "big") + (score + (1 << 8 * size)).to_bytes(size, "big")
    return max(-_LONG - 1, min(_LONG, score)), raw


def top_k(queries: DataFrame, data: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of (id, dim, v) frames made by vectors()."""
    spark = data.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    n = data.count()
    block = min(max(LEAST_BLOCK, n // (2 * spark.sparkContext.defaultParallelism)), MOST_BLOCK)
    n_cells = min(CELLS, max(1, n // block))
    # the lengths of vectors are few; each gives a bounded sample, the first rows by a hash
    first = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    picked = data.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, n // (8 * SAMPLE)))) == 0).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE).collect()
    cells = {}
    for dim in {r.dim for r in picked}:
        own = [r for r in picked if r.dim == dim]
        cells[dim] = Cells(np.array([r.id for r in own]), np.array([r.v for r in own], float), n_cells)

    def placed(it):
        for b in it:
            cell, far = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf)
            for dim, at in _by_dim(b):
                if dim in cells:
                    d = cells[dim].distances(_matrix(b.column(2).take(pa.array(at)), dim))
                    cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["id", "dim", "v", "cell", "far"])

    rows = scratch.save(data.select("id", "dim", "v").mapInArrow(placed, "id long, dim int, v array<double>, cell int, far double"))
    # a row for each length and cell: at most CELLS times the lengths
    known = {(r.dim, r.cell): (r.n, r.far) for r in rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    parts = {c: -(-m // block) for c, (m, _) in known.items()}
    lots = -(-queries.count() // QUERIES) or 1
    part_of = F.create_map(*[x for (dim, cell), m in sorted(parts.items()) for x in (F.lit(f"{dim}.{cell}"), F.lit(m))]) if parts else None
    if part_of is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = rows.withColumn("part", F.pmod(F.xxhash64("id"), part_of[F.concat_ws(".", "dim", "cell")]).cast("int"))
    d = d.select("dim", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("floor"))

    def sent(it):
        """Queries, once for every block whose bound reaches their floor."""
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for dim, at in _by_dim(b):
                q = _matrix(b.column(2).take(pa.array(at)), dim)
                norm = np.sqrt((q**2).sum(1))
                own = cells.get(dim)
                floor = own.floors(q, ids[at], k) if own else np.full(len(at), -np.inf)
                for (of, cell), m in parts.items():
                    if of != dim:
                        continue
                    far = known[of, cell][1]
                    top = np.full(len(at), np.inf) if own is None or np.isinf(far) else q @ own.centres[cell] + norm * (far + 1e-9 * (far + own.norms[cell])) * (1 + 1e-9) + 1e-6
                    go = np.flatnonzero(~(top < floor))
                    for part in range(m if len(go) else 0):
                        full = lambda x, kind, n=len(go): pa.array(np.full(n, x), kind)
                        lot = b.column(3).take(pa.array(at[go]))
                        yield pa.RecordBatch.from_arrays([full(dim, pa.int32()), full(cell, pa.int32()), full(part, pa.int32()), lot, full(1, pa.int32()), pa.array(ids[at[go]]), b.column(2).take(pa.array(at[go])), pa.array(floor[go])], ["dim", "cell", "part", "lot", "side", "id", "v", "floor"])

    asked = queries.select("id", "dim", "v", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int").alias("lot"))
    q = asked.mapInArrow(sent, "dim int, cell int, part int, lot int, side int, id long, v array<double>, floor double")
    block_key = ["dim", "cell", "part", "lot"]
    both = d.unionByName(q).repartition(*block_key).sortWithinPartitions(*block_key, "side", "id")

    def search(it):
        key, tree, held, ids = None, None, [], []

        def answered(rows, v, floor):
            out = []
            for at in range(0, len(rows), QUERY_BATCH):
                found = tree.batch(v[at : at + QUERY_BATCH], rows[at : at + QUERY_BATCH], floor[at : at + QUERY_BATCH])
                out += [(int(r), i, *_key(s)) for r, hits in zip(rows[at : at + QUERY_BATCH], found, strict=True) for s, i in hits]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["query_id", "vec_id", "score", "beyond"])

        for b in it:
            names = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], 1)
            cuts = np.flatnonzero((np.diff(names, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
                now, side = tuple(names[lo, :4].tolist()), names[lo, 4]
                if now != key:
                    key, tree, held, ids = now, None, [], []
                rows, v = b.column(5).to_numpy(zero_copy_only=False)[lo:hi], _matrix(b.column(6).slice(lo, hi - lo), now[0])
                if side == 0:
                    held.append(v)
                    ids.append(rows)
                elif held or tree:
                    if tree is None:
                        tree, held = Search(np.concatenate(held), np.concatenate(ids), k), []
                    yield answered(rows, v, b.column(7).to_numpy(zero_copy_only=False)[lo:hi])

    near = both.select(*block_key, "side", "id", "v", "floor").mapInArrow(search, "query_id long, vec_id long, score long, beyond binary")
    # all but the scores at the ends of a long compare by themselves
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(data.where(F.col("id") % EVERY == 0), data)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
