"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of itself and of its two
neighbours; marginals of the good label, from forward-backward, are averaged
with the lines' lengths as weights into the document's score.

Learning: whole texts of labelled documents in the order of a hash of doc_id,
at most TRAIN_DOCS of them and TRAIN_LINES lines together (a document that
would go beyond is left out), a documented bound on what the driver gathers.
Each line bears its document's label. Of a doc_id with several texts the one of
the least hash is learned from, however often rows repeat. Scoring is narrow:
one scan, no shuffle, whole texts, a few megabytes of them at a time.

Null and empty texts are scored as one empty line. Without labels every score
is 0.5. A null doc_id is scored and is not held out. Repeated rows get equal
scores; a score of exactly 0.5 predicts 1. Empty tables give no rows. Extra
columns are ignored or, in the pipeline, kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Scratch, crc_mod3, documents, pieces

TRAIN_DOCS, TRAIN_LINES = 1500, 200_000
#: Held out: documents whose crc32(doc_id) mod 3 is this.
HELD_OUT = 1

_NAMES = ("upper", "lower", "high", "digit", "symbol", "pipe", "bang", "stop")


def _class_table() -> dict[str, np.ndarray]:
    sets = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "high": bytes(range(128, 256)), "digit": b"0123456789", "symbol": b"#*$%&<>", "pipe": b"|", "bang": b"!?", "stop": b".,;:", "space": b" \t\x0b\x0c\r"}
    out = {}
    for name, members in sets.items():
        out[name] = np.zeros(256, np.uint8)
        out[name][list(members)] = 1
    return out


_CLASSES = _class_table()
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
#: Multipliers of the word hash: any odd numbers spread over 64 bits.
_FOLD = (_FOLD + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_PLACE = (np.arange(64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
N_FEATURES = 14


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its bytes, number of lines of each text) of UTF-8 texts."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[ends]]))
    n = {name: sums(_CLASSES[name][data]) for name in _NAMES}
    gap = _CLASSES["space"][data].astype(bool)
    gap[ends] = True
    first = ~gap
    first[1:] &= gap[:-1]
    word_at = np.flatnonzero(first)
    line_of = np.searchsorted(ends, word_at)
    words = np.bincount(line_of, minlength=len(ends))
    if len(word_at):
        place = np.arange(len(data), dtype=np.int64)
        lengths = np.diff(np.append(word_at, len(data)))
        place -= np.repeat(word_at, lengths) if word_at[0] == 0 else np.concatenate([np.zeros(word_at[0], np.int64), np.repeat(word_at, lengths)])
        value = _FOLD[data] * (_PLACE[place & 63])
        value[gap] = 0
        hashes = np.add.reduceat(value ^ (value >> np.uint64(29)), word_at)
        again = np.zeros(len(word_at), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
        echo = np.bincount(line_of, weights=again, minlength=len(ends))
        order = np.lexsort((hashes, line_of))
        twin = np.zeros(len(word_at), bool)
        twin[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
        twins = np.bincount(line_of[order], weights=twin, minlength=len(ends))
    else:
        echo = twins = np.zeros(len(ends))
    w, letters = np.maximum(words, 1), np.maximum(n["upper"] + n["lower"], 1)
    last = data[np.maximum(ends - 1, 0)]
    x = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            n["symbol"] / w,
            n["pipe"] / w,
            n["bang"] / w,
            n["upper"] / letters,
            n["digit"] / np.maximum(size, 1),
            echo / w,
            twins / w,
            (size - n["high"] // 2) / w,
            n["stop"] / w,
            ((last == 46) & (size > 0)).astype(float),
            ((data[starts] >= 65) & (data[starts] <= 90)).astype(float),
            (words < 4).astype(float),
        ],
        axis=1,
    )
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    return np.clip(x, 0, 20), size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, and whether a neighbour is missing."""
    first = np.zeros(len(x), bool)
    at = np.cumsum(counts)
    first[np.concatenate([[0], at[:-1]])] = True
    last = np.roll(first, -1)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))])


class Lanes:
    """The t-th lines of the texts that have one, longest texts first: the rows of each step of the recursions."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.start = (np.cumsum(counts) - counts)[order]
        # at[t]: texts of more than t lines
        self.at = len(counts) - np.searchsorted(counts[order][::-1], np.arange(int(counts.max(initial=0))), side="right")

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, t: int) -> np.ndarray:
        return self.start[: self.at[t]] + t


def forward_backward(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, counts: np.ndarray):
    """Marginals (rows x 2) and summed pair marginals (2 x 2) and log normalisers; emit: rows x 2 scores."""
    rows = Lanes(counts)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    norm = 0.0
    for t in range(len(rows)):
        at = rows[t]
        if t == 0:
            a = begin + emit[at]
        else:
            p = alpha[at - 1]
            a = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + emit[at]
        alpha[at] = a
    for t in range(len(rows) - 2, -1, -1):
        nxt = rows[t + 1]
        q = emit[nxt] + beta[nxt]
        beta[nxt - 1] = np.stack([np.logaddexp(trans[s, 0] + q[:, 0], trans[s, 1] + q[:, 1]) for s in (0, 1)], 1)
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both - z[:, None])
    pairs = np.zeros((2, 2))
    if len(rows):
        norm = float(z[rows[0]].sum())
        later = np.ones(len(emit), bool)
        later[rows[0]] = False
        at = np.flatnonzero(later)
        pairs = np.exp(alpha[at - 1][:, :, None] + trans[None] + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None]).sum(0)
    return marginal, pairs, norm


class Crf:
    """Weights of the good label's features, transitions and beginning; the bad label scores 0."""

    def __init__(self, mean, scale, w, trans, begin):
        self.mean, self.scale, self.w, self.trans, self.begin = mean, scale, w, trans, begin

    @classmethod
    def flat(cls) -> Crf:
        return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), np.zeros(2))

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.08, decay: float = 1e-4) -> Crf:
        """Maximum likelihood with a quadratic penalty, by Adam on all sequences at once."""
        out = cls.flat()
        if not len(counts):
            return out
        out.mean, out.scale = x.mean(0), x.std(0) + 1e-3
        f = with_neighbours((x - out.mean) / out.scale, counts)
        y = np.repeat(labels, counts)
        edges = counts - 1
        seen = np.array([[edges[labels == 0].sum(), 0], [0, edges[labels == 1].sum()]], float)
        starts = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        theta = [out.w, out.trans, out.begin]
        m1, m2 = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for step in range(1, steps + 1):
            emit = np.stack([np.zeros(len(f)), f @ out.w], 1)
            marginal, pairs, _ = forward_backward(emit, out.trans, out.begin, counts)
            grads = [f.T @ (y - marginal[:, 1]), seen - pairs, starts - marginal[first].sum(0)]
            for p, g, a, b in zip(theta, grads, m1, m2, strict=True):
                g = g / len(f) - decay * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return out

    def line_marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        f = with_neighbours((x - self.mean) / self.scale, counts)
        emit = np.stack([np.zeros(len(f)), f @ self.w], 1)
        return forward_backward(emit, self.trans, self.begin, counts)[0][:, 1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of UTF-8 texts, PIECE_BYTES or one text at a time."""
        out, at = [np.zeros(0)], 0
        ends = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, side="right")))
            out.append(self._scores(texts[at:end]))
            at = end
        return np.concatenate(out)

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        x, size, counts = line_features(texts)
        p = self.line_marginals(x, counts)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = size + 1.0
        return np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, line counts and labels of the bounded sample."""
    scratch = Scratch(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod3("doc_id") != HELD_OUT))
    own = own.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)
    # at most TRAIN_DOCS rows of two numbers, so the broadcast is bounded
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(own), "_id")
    one = picked.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_y")).alias("r")).select("_id", "r._text", "r._y")
    one = scratch.save(one.withColumn("_n", F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1), few=True)
    taken, lines = [], 0
    for r in one.select("_id", "_n").orderBy(F.xxhash64("_id"), "_id").collect():
        if lines + r._n <= TRAIN_LINES:
            taken.append(r._id)
            lines += r._n

    def run(it):
        for b in pieces(it, 1):
            ids, texts, ys = (b.column(i).to_pylist() for i in range(3))
            if texts:
                x, _, counts = line_features([t.encode("utf-8", "surrogatepass") for t in texts])
                parts = np.split(x.astype("<f4"), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "y", "x"])

    rows = sorted(one.where(F.col("_id").isin(taken)).select("_id", "_text", "_y").mapInArrow(run, "id long, y int, x binary").collect())
    scratch.close()
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    return (np.vstack(xs) if xs else np.zeros((0, N_FEATURES))), np.array([len(x) for x in xs], np.int64), np.array([int(r.y == 1) for r in rows], np.int64)


def trained(docs: DataFrame, labels: DataFrame) -> Crf:
    return Crf.fit(*training_rows(docs, labels))


def score_column(model: Crf, text: str = "text") -> Column:
    """The score of a text column, by an Arrow-batched function."""
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores([(t or "").encode("utf-8", "surrogatepass") for t in s]))

    return score(F.col(text).cast("string"))


def scored(docs: DataFrame, model: Crf) -> DataFrame:
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod3("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
