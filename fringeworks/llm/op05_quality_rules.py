"""Quality rules: base statistics of every text, then robust multivariate outliers.

For each language and source, the minimum covariance determinant gives a
robust centre and covariance of transformed statistic vectors; a document is
rejected when its Mahalanobis distance is beyond the threshold.

The determinant is minimised by concentration steps on the (n + DIM + 1) / 2
nearest rows from two deterministic beginnings (median and scaled median
deviation; mean and covariance of the half whose largest scaled deviation from
the median is least). Both run until the determinant falls no further, and the
smaller one counts, so that up to nearly half of a group may be outliers. A step
is two grouped aggregates over all documents of a group: the h-th smallest
distance, then sums over those within it. A group is never gathered: a hot
source is pre-aggregated where it lies, and what moves is a few sums per group
and task. Scales have floors, as most texts show none of some faults and half a
group may agree exactly.

Groups of fewer than MIN_GROUP documents use their language's estimate, and
languages of fewer the estimate of all documents; estimates that no document
uses are not made. Only documents that pass the
base rules take part. Null text is empty: base_failed. Null language or source
is a group of its own. Repeated rows count each, and get equal results; equal
distances are judged alike. Very long texts are counted whole, a few at a time.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, pieces, same

MIN_WORDS, MIN_GROUP, STEPS = 50, 40, 4
#: STEPS is the least number of steps, then the logarithm of the determinant must fall by TOLERANCE for another one.
TOLERANCE = 1e-3
#: Share of a group that the concentrated half holds, besides the (DIM + 1) / 2 rows on top.
SHARE = 0.5
#: Share of clean texts of a normal group that may be rejected; LIMIT follows from it by the chi-square distribution.
REJECTED_SHARE = 4.3e-8
#: Least standard deviation of each transformed statistic.
FLOORS = (0.12, 0.12, 0.25, 0.25)
DIM = 4
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    pair = ids[:-1] * k + ids[1:]
    if k > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * k + ids[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    at = order[twin]
    covered = np.zeros(n, bool)
    for step in (0, 1, 2):
        covered[at + step] = True
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        filled = [x for x in lines if WORD.search(x)]
        dup = len(filled) - len(set(filled))
    return len(words), sum(map(len, words)), symbols, dup, repeat_words(words)


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed."""

    def run(it):
        for b in pieces(it, 3):
            rows = np.array([text_stats(t or "") for t in b.column(3).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(rows[:, i].copy()) for i in range(5))], ["doc_id", "lang", "source", *_COUNTS])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _transformed() -> list:
    """Logarithms of rates per word, of word length; a rate's logarithm is of one plus ten times it."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(10 * F.col("n_dup_lines") / n), F.log1p(10 * F.col("n_repeat_words") / n)]


def _half(column: str):
    """The h-th smallest value of a column, h = (n + DIM + 1) / 2, from a list of percentiles; within n / 1000 below h (never under n / 2) for groups of 1,000 rows or more."""
    n = F.max("_n")
    shares = [SHARE + k / 1000 for k in range(1 + 500 * (DIM + 1) // MIN_GROUP)]
    at = F.floor((F.floor((n + DIM + 1) / 2) / n - SHARE) * 1000).cast("int") + 1
    return F.element_at(F.percentile_approx(column, shares, 10_000), F.greatest(at, F.lit(1)))


def _concentrated_on(near: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """by, _n, _m, _p, _ld (logarithm of the determinant) of the rows of least _d in each group."""
    x = [f"_x{i}" for i in range(DIM)]
    cut = scratch.save(near.groupBy(*by).agg(_half("_d").alias("_cut")))
    near = _joined(near, cut, by).where(F.col("_d") <= F.col("_cut"))
    sums = near.groupBy(*by).agg(F.max("_n").alias("_n"), F.count(F.lit(1)).cast("double").alias("_k"), F.array(*[F.sum(F.col(c)) for c in x]).alias("_s"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in x for b in x]).alias("_q"))
    out = scratch.save(_inverted(sums, by))
    scratch.drop(cut)
    return out


def _estimates(stats: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """keys, _n, _m (mean), _p (flat inverse covariance), _ld: the estimate of each group of at least MIN_GROUP rows."""
    x = [f"_x{i}" for i in range(DIM)]
    med = [F.percentile_approx(c, 0.5, 2000).alias(f"_c{i}") for i, c in enumerate(x)]
    groups = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *med).where(F.col("_n") >= MIN_GROUP)
    groups = scratch.save(groups)
    joined = _joined(stats, groups, keys)
    mad = [F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(c) - F.col(f"_c{i}")), 0.5, 2000), F.lit(FLOORS[i])).alias(f"_s{i}") for i, c in enumerate(x)]
    spread = scratch.save(joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.first(f"_c{i}").alias(f"_c{i}") for i in range(DIM)], *mad))
    by = [*keys, "_start"]
    none = F.lit(float("inf")).alias("_ld")
    first = spread.select(*keys, F.lit(0).alias("_start"), "_n", F.array(*[f"_c{i}" for i in range(DIM)]).alias("_m"), F.flatten(F.array(*[F.array(*[(1 / F.pow(f"_s{i}", F.lit(2)) if i == j else F.lit(0.0)) for j in range(DIM)]) for i in range(DIM)])).alias("_p"), none)
    largest = F.greatest(*[F.abs(F.col(c) - F.col(f"_c{i}")) / F.col(f"_s{i}") for i, c in enumerate(x)])
    second = _concentrated_on(_joined(stats, spread, keys).withColumns({"_d": largest, "_start": F.lit(1)}), by, scratch)
    est, settled, step = scratch.save(first.unionByName(second.withColumn("_ld", none))), [], 0
    names = ("_n", "_m", "_p", "_ld")
    while True:
        step += 1
        new = _concentrated_on(_joined(stats, est, keys).withColumn("_d", distance(x)), by, scratch)
        old = est.select(*by, F.struct(*names).alias("_old"))
        more = F.lit(step < STEPS) | (F.col("_ld") < F.col("_old._ld") - TOLERANCE)
        both = _joined(new, old, by).withColumn("_more", more)
        both = both.select(*by, "_more", F.when(F.col("_more") | (F.col("_ld") <= F.col("_old._ld")), F.struct(*names)).otherwise(F.col("_old")).alias("_e"))
        both = scratch.save(both.select(*by, "_more", "_e.*"))
        going, n = both.agg(F.count_if("_more"), F.count(F.lit(1))).first()
        if going < n:
            settled.append(both.where(~F.col("_more")).drop("_more"))
        est = both.where("_more").drop("_more")
        if not going:
            break
        est = scratch.save(est) if going < n else est
    out = settled[0] if settled else est
    for one in settled[1:]:
        out = out.unionByName(one)
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("_ld", "_start")).alias("_e"))
    return scratch.save(best.select(*keys, "_e.*"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on null-safe keys; b is a written table of one row a group, so Spark knows its size and broadcasts only a small one."""
    names = {k: f"_g_{k}" for k in keys}
    b = b.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in b.columns if c not in keys and c not in a.columns])
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & same(F.col(k), F.col(n))
    return a.join(b, cond).drop(*names.values())


def distance(x: list[str]):
    """Squared Mahalanobis distance of the columns x from _m under _p."""
    d = [F.col(c) - F.col("_m")[i] for i, c in enumerate(x)]
    out = F.lit(0.0)
    for i in range(DIM):
        for j in range(DIM):
            out = out + d[i] * d[j] * F.col("_p")[i * DIM + j]
    return out


def _chi2_below(v: float, k: int) -> float:
    """Distribution function of chi-square with an even number k of degrees of freedom."""
    return 1 - math.exp(-v / 2) * sum((v / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(above: float, k: int) -> float:
    """The value that a share above of chi-square exceeds."""
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(k // 2))
        low, high = (mid, high) if tail > above else (low, mid)
    return low


#: Squared distance beyond which a text is rejected.
LIMIT = _chi2_quantile(REJECTED_SHARE, DIM)


#: Of a normal sample cut at the central SHARE in 4 dimensions, the covariance falls short by this factor.
def consistency(share: float = SHARE, dim: int = DIM) -> float:
    """share / P(chi2 with dim+2 degrees <= q), q the share-quantile of chi2 with dim degrees; dim even."""
    return share / _chi2_below(_chi2_quantile(1 - share, dim), dim + 2)


def concentrated(k: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and inverse covariances from counts, sums and sums of products; floors go onto the diagonal."""
    m = s / k[:, None]
    cov = q.reshape(-1, DIM, DIM) / k[:, None, None] - m[:, :, None] * m[:, None, :]
    cov = (cov + cov.transpose(0, 2, 1)) / 2 * consistency() + np.diag(np.square(FLOORS))
    return m, np.linalg.inv(cov)


def _inverted(sums: DataFrame, keys: list[str]) -> DataFrame:
    n_keys = len(keys)

    def run(it):
        for b in it:
            if b.num_rows:
                k, s, q = (np.array(b.column(i).to_pylist(), float) for i in (n_keys + 1, n_keys + 2, n_keys + 3))
                m, p = concentrated(k, s, q)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keys + 1)), pa.array(list(m), pa.list_(pa.float64())), pa.array(list(p.reshape(len(p), -1)), pa.list_(pa.float64())), pa.array(-np.linalg.slogdet(p)[1])], [*keys, "_n", "_m", "_p", "_ld"])

    types = dict(sums.dtypes)
    return sums.select(*keys, "_n", "_k", "_s", "_q").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", _n long, _m array<double>, _p array<double>, _ld double")


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_g_{k}" for k in keys})


def _same_keys(keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & same(F.col(k), F.col(f"_g_{k}"))
    return cond


def judged(docs: DataFrame) -> DataFrame:
    """Every document's counts, base_failed, squared distance and verdict."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(base_stats(docs).withColumns({f"_x{i}": c for i, c in enumerate(_transformed())}))
    own = stats.where(~F.col("base_failed"))
    x = [f"_x{i}" for i in range(DIM)]
    levels = [["lang", "source"], ["lang"], ["_all"]]
    own = own.withColumn("_all", F.lit(""))
    out, lone = stats.withColumn("_all", F.lit("")), own
    for at, keys in enumerate(levels):
        rows = own
        if at:
            if lone.isEmpty():
                break
            rows = own.join(_named(scratch.save(lone.select(*keys).distinct()), keys), _same_keys(keys), "left_semi")
        est = _estimates(rows, keys, scratch)
        named = _named(est.select(*keys, F.col("_m").alias(f"_m{at}"), F.col("_p").alias(f"_p{at}")), keys)
        out = out.join(named, _same_keys(keys), "left").drop(*[f"_g_{k}" for k in keys])
        lone = lone.join(named, _same_keys(keys), "left_anti")
    out = out.withColumns({c: F.coalesce(*[f"{c}{i}" for i in range(len(levels)) if f"{c}{i}" in out.columns]) for c in ("_m", "_p")})
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.coalesce(distance(x), F.lit(0.0))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= LIMIT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", *_COUNTS, "base_failed", "kept", "distance")
