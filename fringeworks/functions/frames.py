"""Velocity frames of frequencies as column expressions: the observer's velocity from the time, the place and the direction.

Low-precision formulas of almanacs stand in for an ephemeris. The Sun counts as
the barycentre, so velocities are right to some 15 m/s: 70 Hz at 1.4 GHz.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import C_LIGHT

#: Modified Julian date of J2000, metres in an astronomical unit, turns of the Earth in radians a second.
J2000, AU, EARTH_RATE = 51544.5, 1.495978707e11, 7.292115e-5
#: Fixed values, degrees and degrees a day: mean longitude of the Sun less precession, mean anomaly, obliquity, angle of the Earth's turn from the axes of J2000.
SUN_LONGITUDE, SUN_ANOMALY, OBLIQUITY, EARTH_TURN = (280.459, 0.98564736 - 3.8246e-5), (357.529, 0.98560028), 23.439, (280.46061837504, 360.9856122880876)
#: Terms of the equation of the centre (degrees) and of the distance (astronomical units).
CENTRE, DISTANCE = (1.915, 0.020), (1.00014, -0.01671, -0.00014)
#: The kinematic local standard of rest, m/s towards a J2000 direction in degrees.
LSRK = (20000.0, 270.9595417, 30.0046667)
FRAMES = ("TOPO", "BARY", "LSRK")

Vector = tuple[Column, Column, Column]


def _angle(at: tuple[float, float], days: Column) -> Column:
    return F.radians(F.pmod(at[0] + at[1] * days, F.lit(360.0)))


def _days(seconds) -> Column:
    return (F.col(seconds) if isinstance(seconds, str) else seconds) / 86400.0 - J2000


def orbital_velocity(seconds) -> Vector:
    """The Earth's velocity about the Sun in m/s along the axes of J2000; seconds since MJD 0."""
    n = _days(seconds)
    g, rate = _angle(SUN_ANOMALY, n), math.radians(SUN_ANOMALY[1])
    lam = _angle(SUN_LONGITUDE, n) + math.radians(CENTRE[0]) * F.sin(g) + math.radians(CENTRE[1]) * F.sin(2 * g)
    turn = math.radians(SUN_LONGITUDE[1]) + rate * (math.radians(CENTRE[0]) * F.cos(g) + 2 * math.radians(CENTRE[1]) * F.cos(2 * g))
    r = DISTANCE[0] + DISTANCE[1] * F.cos(g) + DISTANCE[2] * F.cos(2 * g)
    recede = -rate * (DISTANCE[1] * F.sin(g) + 2 * DISTANCE[2] * F.sin(2 * g))
    # the Earth stands opposite to where the Sun is seen
    x, y = (-(AU / 86400) * c for c in (recede * F.cos(lam) - r * turn * F.sin(lam), recede * F.sin(lam) + r * turn * F.cos(lam)))
    tilt = math.radians(OBLIQUITY)
    return x, y * math.cos(tilt), y * math.sin(tilt)


def rotation_velocity(seconds, x: float, y: float) -> Vector:
    """Velocity in m/s of a place that turns with the Earth; x, y metres from its axis, towards Greenwich and east."""
    turned = _angle(EARTH_TURN, _days(seconds))
    return -EARTH_RATE * (x * F.sin(turned) + y * F.cos(turned)), EARTH_RATE * (x * F.cos(turned) - y * F.sin(turned)), F.lit(0.0)


def _towards(v: Vector, ra, dec) -> Column:
    return v[0] * F.cos(dec) * F.cos(ra) + v[1] * F.cos(dec) * F.sin(ra) + v[2] * F.sin(dec)


def observer_velocity(frame: str, seconds, ra, dec, x: float = 0.0, y: float = 0.0) -> Column:
    """m/s with which the observer moves towards a J2000 direction (radians), as seen from a frame of FRAMES."""
    if frame not in FRAMES:
        raise ValueError(f"frame {frame!r}: one of {', '.join(FRAMES)}")
    ra, dec = (F.col(c) if isinstance(c, str) else c for c in (ra, dec))
    if frame == "TOPO":
        return F.lit(0.0)
    out = _towards(orbital_velocity(seconds), ra, dec) + _towards(rotation_velocity(seconds, x, y), ra, dec)
    if frame == "LSRK":
        speed, a, d = LSRK[0], math.radians(LSRK[1]), math.radians(LSRK[2])
        sun = tuple(F.lit(speed * c) for c in (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)))
        out = out + _towards(sun, ra, dec)
    return out


def to_frame(freq, velocity) -> Column:
    """An observed frequency as the frame has it, against which the observer moves towards the source with velocity (m/s)."""
    beta = velocity / C_LIGHT
    return (F.col(freq) if isinstance(freq, str) else freq) * F.sqrt((1 - beta) / (1 + beta))


def from_frame(freq, velocity) -> Column:
    """The inverse of to_frame: the frequency that the observer sees."""
    return to_frame(freq, -velocity)


def channel_shift(freq, velocity, step: float) -> Column:
    """Channels by which a channel of a cube in the frame lies beyond the observed channel that it was made from."""
    f = F.col(freq) if isinstance(freq, str) else freq
    return F.round((f - from_frame(f, velocity)) / step).cast("int")
