"""Simulated observations: rows of an array that tracks a source, noise and corruption."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def observed_rows(spark: SparkSession, antennas: DataFrame, n_cycles: int, degrees_per_cycle: float, n_feeds: int, declination: float, autocorrelations: bool = False) -> DataFrame:
    """One row per cycle, feed and pair antenna1 < antenna2: u, v, w are rotated antenna differences.

    The array is a short list (n^2 / 2 baselines); cycles and feeds are generated in place.
    """
    a, b = antennas.alias("a"), antennas.alias("b")
    pair = F.col("a.antenna") <= F.col("b.antenna") if autocorrelations else F.col("a.antenna") < F.col("b.antenna")
    base = a.join(b, pair).select(F.col("a.antenna").alias("antenna1"), F.col("b.antenna").alias("antenna2"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d{c}") for c in "xyz"])
    rows = base.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(n_cycles - 1)))).withColumn("feed", F.explode(F.sequence(F.lit(0), F.lit(n_feeds - 1))))
    h, d = F.radians(F.col("cycle") * degrees_per_cycle), F.lit(declination)
    x, y, z = F.col("dx"), F.col("dy"), F.col("dz")
    return rows.withColumns({"u": F.sin(h) * x + F.cos(h) * y, "v": -F.sin(d) * F.cos(h) * x + F.sin(d) * F.sin(h) * y + F.cos(d) * z, "w": F.cos(d) * F.cos(h) * x - F.cos(d) * F.sin(h) * y + F.sin(d) * z})


#: A prime, so that squares and products below it fit a long.
_PRIME = 2147483647


def _rounds(key, seed: int, times, plus, modulo):
    """Three rounds of x -> x * x + c modulo a prime, on key and seed."""
    x = modulo(plus(times(modulo(key), 48271), 1000003 * seed + 12345))
    for c in (seed + 918273, 546372, 112358 + 7 * seed):
        x = modulo(plus(times(x, x), c))
    return x


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from a whole-number key and a seed: a replayed task draws the same."""
    modulo = lambda x: F.pmod(x.cast("long"), F.lit(_PRIME))
    return _rounds(key, seed, lambda a, b: a * b, lambda a, b: a + b, modulo) / float(_PRIME)


def uniform_sql(key: str, seed: int) -> str:
    """The same for DuckDB; key is at least 0."""
    text = lambda op: lambda a, b: f"({a} {op} {b})"
    modulo = lambda x: f"(CAST({x} AS BIGINT) % {_PRIME})"
    x = modulo(f"{modulo(key)} * 48271 + {1000003 * seed + 12345}")
    for c in (seed + 918273, 546372, 112358 + 7 * seed):
        x = f"list_transform([{x}], lambda x: (x * x + {c}) % {_PRIME})[1]"
    return f"({x} / {float(_PRIME)!r})"


def with_noise(vis: DataFrame, sigma: float, seed: int, key: Column) -> DataFrame:
    """Gaussian noise on both parts, drawn from a row's key; autocorrelations get real noise only."""
    auto = F.col("antenna1") == F.col("antenna2")
    size, turn = sigma * F.sqrt(-2 * F.log(1 - uniform(key, seed))), 2 * math.pi * uniform(key, seed + 1)
    return vis.withColumns({"re": F.col("re") + size * F.cos(turn), "im": F.when(auto, F.col("im")).otherwise(F.col("im") + size * F.sin(turn))})


def random_gains(seen: DataFrame, n_beams: int, low: float, high: float, seed: int, leakage: float = 0.0) -> DataFrame:
    """antenna, beam, kind, re, im for the antennas and beams (under n_beams) in seen: gains of amplitudes from low to high, leakages up to leakage, all of any phase."""
    kind = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(("g11", "g22", "d12", "d21"))])).alias("k")
    rows = seen.select("antenna", "beam").distinct().select("antenna", "beam", kind)
    rows = rows.withColumn("id", (F.col("antenna").cast("long") * n_beams + F.col("beam")) * 4 + F.col("k.i"))
    u, turn = uniform(F.col("id"), seed), 2 * math.pi * uniform(F.col("id"), seed + 1)
    amp = F.when(F.col("k.i") < 2, low + (high - low) * u).otherwise(leakage * u)
    return rows.select("antenna", "beam", "k.kind", (amp * F.cos(turn)).alias("re"), (amp * F.sin(turn)).alias("im"))


def channel_sigma(diameter1, diameter2, largest: float, rms: float):
    """Noise of a baseline of unequal dishes and its weight."""
    s = largest * largest / (F.col(diameter1) * F.col(diameter2)) * rms
    return s, 1 / (s * s)
