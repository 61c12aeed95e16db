"""Least squares by Golub-Kahan bidiagonalisation over Spark: gains and bandpasses with damping and smoothing.

The matrix is never built. A round is one pass over the rows of the system: a
task multiplies what it holds and leaves one number an unknown that it touches,
Spark sums them. The unknowns (antennas x channels x keys, whatever the number
of samples) are the only vectors outside of Spark, and their number is checked.

The left vectors of the bidiagonalisation have a component a row, so they stay
implicit: each is A w + c b for some w in the space of unknowns and a number c,
and both its norm and A' of it come from the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknowns (real numbers) of one system: 32 MB a vector.
MOST_UNKNOWNS = 1 << 22

#: (w, c) -> (squared norm of A w + c b, A' (A w + c b)).
Product = Callable[[np.ndarray, float], tuple[float, np.ndarray]]


def lsqr(product: Product, n: int, rounds: int = 50, tolerance: float = 1e-8) -> tuple[np.ndarray, int]:
    """(x, passes): x has the least |A x - b|, and the least |x| among these."""
    x = np.zeros(n)
    square, t = product(np.zeros(n), 1.0)
    beta = square**0.5
    if beta == 0:
        return x, 1
    w, c = np.zeros(n), 1.0 / beta
    v = t / beta
    alpha = np.linalg.norm(v)
    if alpha == 0:
        return x, 1
    v = v / alpha
    step, phi_bar, rho_bar = v.copy(), beta, alpha
    least = tolerance * alpha * beta
    for i in range(1, rounds + 1):
        w, c = v - alpha * w, -alpha * c
        square, t = product(w, c)
        beta = square**0.5
        if beta > 0:
            w, c, t = w / beta, c / beta, t / beta
            v = t - beta * v
            alpha = np.linalg.norm(v)
            v = v / alpha if alpha > 0 else v
        else:
            alpha = 0.0
        rho = np.hypot(rho_bar, beta)
        cosine, sine = rho_bar / rho, beta / rho
        theta, rho_bar = sine * alpha, -cosine * alpha
        phi, phi_bar = cosine * phi_bar, sine * phi_bar
        x = x + (phi / rho) * step
        if phi_bar * alpha * abs(cosine) <= least:
            return x, i + 1
        step = v - (theta / rho) * step
    return x, rounds + 1


@dataclass
class Rules:
    """What is asked of gains beside fitting the products.

    damping: weight of each change of a gain. smoothing: weight of the
    difference of neighbouring channels (order 1) or of its difference (order
    2), raised from least_smoothing in equal factors over the outer rounds.
    breaks: channels that begin a new spectral piece; no difference crosses them.
    """

    damping: float = 0.0
    smoothing: float = 0.0
    least_smoothing: float | None = None
    order: int = 2
    breaks: tuple[int, ...] = ()
    outer: int = 8
    inner: int = 25
    #: A step's inner accuracy, and the relative step that ends the outer rounds.
    tolerance: float = 1e-3
    still: float = 1e-6
    history: list[tuple[float, int]] = field(default_factory=list)

    def level(self, i: int) -> float:
        if not self.smoothing or self.least_smoothing is None or self.outer < 2:
            return self.smoothing
        share = min(1.0, i / (self.outer - 1))
        return self.least_smoothing ** (1 - share) * self.smoothing**share


def differences(n: int, order: int, breaks: tuple[int, ...] = ()) -> np.ndarray:
    """Rows of coefficients over n channels, of one order, within the pieces between breaks."""
    row = np.array([1.0, -1.0]) if order == 1 else np.array([1.0, -2.0, 1.0])
    out = []
    for i in range(n - order):
        if not any(i < b <= i + order for b in breaks):
            r = np.zeros(n)
            r[i : i + order + 1] = row
            out.append(r)
    return np.array(out).reshape(-1, n)


def _pass(gains: np.ndarray, w: np.ndarray, c: float):
    """Per task: unknown, value (A' u) and, at unknown -1, the squared norm of u = A w + c b, over the products' rows."""
    flat = gains.ravel()

    def run(it):
        import pyarrow as pa

        n = len(flat)
        total, square = np.zeros(2 * n), 0.0
        x, y = w[:n], w[n:]
        for b in it:
            i, j = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vm_re, vm_im, mm = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            root = np.sqrt(mm)
            gi, gj = flat[i], flat[j]
            rest = (vm_re + 1j * vm_im) / mm - gi * gj.conj()
            u = root * ((x[i] + 1j * y[i]) * gj.conj() + gi * (x[j] - 1j * y[j]) + c * rest)
            square += float((u.real**2 + u.imag**2).sum())
            for at, part in ((i, root * u * gj), (j, root * (u.conj() * gi))):
                total[:n] += np.bincount(at, part.real, n)
                total[n:] += np.bincount(at, part.imag, n)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(total[hit], square))], ["unknown", "value"])

    return run


def _summed(rows: DataFrame, gains: np.ndarray, w: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    n = 2 * gains.size
    out = rows.mapInArrow(_pass(gains, w, c), "unknown long, value double").groupBy("unknown").agg(F.sum("value").alias("value")).toPandas()
    at, value = out["unknown"].to_numpy(), out["value"].to_numpy()
    t = np.zeros(n)
    t[at[at >= 0]] = value[at >= 0]
    return float(value[at < 0].sum()), t


def _with_rules(product: Product, gains: np.ndarray, rules: Rules, smooth: float, live: np.ndarray, reference: int) -> Product:
    """The product of the system with the rows of damping and smoothing below it: they touch unknowns only, so they need no pass.

    The reference antenna's gain is real: no phase is free, and smoothing means something.
    """
    n = gains.size
    free = np.ones((2, *gains.shape))
    free[1, :, reference] = 0
    free = free.ravel()
    d = differences(gains.shape[-1], rules.order, rules.breaks) * smooth
    both = (live.astype(float) @ (np.abs(d) > 0).T.astype(float)) == (np.abs(d) > 0).sum(1)  # differences of solved gains only

    def shaped(w: np.ndarray) -> np.ndarray:
        return (w[:n] + 1j * w[n:]).reshape(gains.shape)

    def whole(w: np.ndarray, c: float) -> tuple[float, np.ndarray]:
        w = w * free
        square, t = product(w, c)
        change = shaped(w)
        if rules.damping:
            square += float((np.abs(rules.damping * change) ** 2).sum())
            t = t + rules.damping**2 * w
        if smooth and len(d):
            u = (change - c * gains) @ d.T * both
            back = u @ d
            square += float((np.abs(u) ** 2).sum())
            t = t + np.concatenate([back.real.ravel(), back.imag.ravel()])
        return square, t * free

    return whole


def solved_bandpass(products: DataFrame, by: list[str], antennas: int, channels: int, rules: Rules | None = None, reference: int = 0) -> DataFrame:
    """by, antenna, chan, g_re, g_im, valid from products per baseline and channel (antenna1, antenna2, chan, vm_re, vm_im, mm_re).

    Gauss-Newton over all antennas, channels and keys together, each step by
    lsqr. The reference antenna's gain is real and positive.
    Gains without any products are 1 and not valid. rules.history gets the
    relative step and the passes of every outer round.
    """
    rules = rules or Rules()
    spark = products.sparkSession
    keys = [tuple(r) for r in products.select(*by).distinct().limit(MOST_UNKNOWNS // (2 * antennas * channels) + 2).collect()] if by else [()]
    if 2 * len(keys) * antennas * channels > MOST_UNKNOWNS:
        raise ValueError(f"more than {MOST_UNKNOWNS} unknowns at once: solve fewer keys at a time")
    good = products.where(f"mm_re > 0 AND antenna1 <> antenna2 AND chan >= 0 AND chan < {channels}")
    if by:
        names = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], ", ".join(f"{b} {dict(products.dtypes)[b]}" for b in by) + ", _key int") if keys else None
        cond = [F.col(f"p.{b}").eqNullSafe(F.col(f"k.{b}")) for b in by]
        at = good.alias("p").join(F.broadcast(names).alias("k"), cond).select("p.antenna1", "p.antenna2", "p.chan", "p.vm_re", "p.vm_im", "p.mm_re", "_key") if keys else None
    else:
        at = good.withColumn("_key", F.lit(0))
    schema = ", ".join([f"{b} {dict(products.dtypes)[b]}" for b in by] + ["antenna int, chan int, g_re double, g_im double, valid boolean"])
    if at is None:
        return spark.createDataFrame([], schema)
    place = lambda a: ((F.col("_key").cast("long") * antennas + F.col(a)) * channels + F.col("chan")).alias(f"_{a}")
    rows = at.select(place("antenna1"), place("antenna2"), *[F.col(c).cast("double").alias(c) for c in ("vm_re", "vm_im", "mm_re")]).persist()

    shape = (len(keys), antennas, channels)
    gains = np.ones(shape, complex)
    seen = rows.select(F.explode(F.array("_antenna1", "_antenna2")).alias("u")).distinct().toPandas()["u"].to_numpy()
    live = np.zeros(gains.size, bool)
    live[seen.astype(np.int64)] = True
    live = live.reshape(shape)
    for i in range(rules.outer):
        product = _with_rules(lambda w, c: _summed(rows, gains, w, c), gains, rules, rules.level(i), live, reference)
        x, passes = lsqr(product, 2 * gains.size, rules.inner, rules.tolerance)
        change = (x[: gains.size] + 1j * x[gains.size :]).reshape(shape)
        moved = float(np.linalg.norm(change) / max(np.linalg.norm(gains), 1e-300))
        gains = gains + change
        rules.history.append((moved, passes))
        if moved < rules.still:
            break
    rows.unpersist()
    turn = gains[:, reference : reference + 1]
    gains = gains * np.where(np.abs(turn) > 0, turn.conj() / np.maximum(np.abs(turn), 1e-300), 1.0)
    gains = np.where(live, gains, 1.0)
    return _rows_of(spark, keys, gains, live, schema)


def _rows_of(spark, keys: list[tuple], gains: np.ndarray, live: np.ndarray, schema: str) -> DataFrame:
    import pandas as pd

    k, a, c = (x.ravel() for x in np.indices(gains.shape))
    columns = {f"_b{i}": [key[i] for key in keys] for i in range(len(keys[0]) if keys else 0)}
    pdf = pd.DataFrame({n: pd.Series(v, dtype=object).to_numpy()[k] for n, v in columns.items()} | {"antenna": a.astype("int32"), "chan": c.astype("int32"), "g_re": gains.real.ravel(), "g_im": gains.imag.ravel(), "valid": live.ravel()})
    return spark.createDataFrame(pdf, schema)


def roughness(gains: DataFrame, by: list[str]) -> DataFrame:
    """by, rough: mean square of the second difference along channels, of neighbours that are there."""
    first = gains.select(*by, "chan", "g_re", "g_im")
    moved = [first.select(*by, (F.col("chan") + s).alias("chan"), F.col("g_re").alias(f"r{i}"), F.col("g_im").alias(f"i{i}")) for i, s in ((0, 1), (2, -1))]
    j = first.join(moved[0], [*by, "chan"]).join(moved[1], [*by, "chan"])
    bend = lambda p, c: (F.col(f"{p}0") - 2 * F.col(c) + F.col(f"{p}2")) ** 2
    return j.groupBy(*by).agg(F.avg(bend("r", "g_re") + bend("i", "g_im")).alias("rough"))
