"""Complex numbers as pairs of double columns. Spark has no complex type; the algebra is written out and stays in codegen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Cx:
    """A complex value: two columns."""

    re: Column
    im: Column

    @classmethod
    def of(cls, re, im=0.0) -> Cx:
        return cls(_col(re), _col(im))

    @classmethod
    def phasor(cls, phase) -> Cx:
        """exp(i phase)."""
        p = _col(phase)
        return cls(F.cos(p), F.sin(p))

    @classmethod
    def polar(cls, amplitude, phase) -> Cx:
        return cls.phasor(phase) * _col(amplitude)

    def __add__(self, o: Cx) -> Cx:
        return Cx(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Cx) -> Cx:
        return Cx(self.re - o.re, self.im - o.im)

    def __mul__(self, o) -> Cx:
        if isinstance(o, Cx):
            return Cx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)
        return Cx(self.re * _col(o), self.im * _col(o))

    def __truediv__(self, o) -> Cx:
        if isinstance(o, Cx):
            n = self * o.conj()
            return Cx(n.re / o.abs2(), n.im / o.abs2())
        return Cx(self.re / _col(o), self.im / _col(o))

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def arg(self) -> Column:
        return F.atan2(self.im, self.re)

    def cols(self, re: str, im: str) -> list[Column]:
        return [self.re.alias(re), self.im.alias(im)]


def sums(value: Cx, re: str, im: str) -> list[Column]:
    """Aggregates: the sum of a complex value."""
    return [F.sum(value.re).alias(re), F.sum(value.im).alias(im)]
