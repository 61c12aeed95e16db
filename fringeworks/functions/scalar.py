"""Scalar and geometric functions as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .complexcols import Cx, _col

#: Fixed value: the speed of light, m/s.
C_LIGHT = 299792458.0
TWO_PI = 2 * math.pi


def rnd(x, digits: int = 6) -> Column:
    """Rounded for comparison; the shift keeps exact decimal ties from rounding both ways."""
    return F.round(_col(x) + 1e-9, digits) + 0.0


def nint(x) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(_col(x)) * F.floor(F.abs(_col(x)) + 0.5)


def polynomial(x, coefficients) -> Column:
    """Horner's scheme; the coefficient of the highest power comes first."""
    x = _col(x)
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), coefficients[1:], F.lit(float(coefficients[0])))


#: Cubic in log10(MHz) for log10(Jy) of the calibrator 1934-638 (Reynolds), highest power first.
FLUX_1934 = (0.605334, -7.0977, 26.4908, -30.7667)


def flux_1934(mhz) -> Column:
    """Flux density (Jy) of 1934-638; null outside 500 MHz to 10 GHz, where the model does not hold."""
    f = _col(mhz)
    return F.when((f > 500) & (f < 10000), F.pow(F.lit(10.0), polynomial(F.log10(f), FLUX_1934)))


def power_law(flux, freq, index, ref_freq) -> Column:
    """flux * (freq / ref_freq) ** index; no scaling where the index is 0."""
    return F.when(_col(index) == 0, _col(flux)).otherwise(_col(flux) * F.pow(_col(freq) / _col(ref_freq), _col(index)))


def source_phase(freq, u, v, w, l, m) -> Column:  # noqa: E741
    """2 pi f (l u + m v + (n - 1) w) / c for metres and direction cosines."""
    n = F.sqrt(1 - (_col(l) * _col(l) + _col(m) * _col(m)))
    return F.lit(TWO_PI) * _col(freq) * (_col(l) * _col(u) + _col(m) * _col(v) + (n - 1) * _col(w)) / C_LIGHT


def point_source(freq, u, v, w, flux, l, m, index=0.0, ref_freq=1.0) -> Cx:  # noqa: E741
    return Cx.polar(power_law(flux, freq, index, ref_freq), source_phase(freq, u, v, w, l, m))


def gaussian_taper(freq, u, v, bmaj, bmin, bpa) -> Column:
    """Loss of correlation of an elliptical Gaussian source; widths at half maximum in radians."""
    up = (F.cos(_col(bpa)) * _col(u) + F.sin(_col(bpa)) * _col(v)) / C_LIGHT
    vp = (F.cos(_col(bpa)) * _col(v) - F.sin(_col(bpa)) * _col(u)) / C_LIGHT
    r = (F.pow(_col(bmaj) * up, 2) + F.pow(_col(bmin) * vp, 2)) * (math.pi**2 / (4 * math.log(2)))
    return F.exp(-r * _col(freq) * _col(freq))


def offsets(lon, lat, ref_lon, ref_lat) -> tuple[Column, Column]:
    """Offsets (radians) of a direction from a reference direction."""
    lon, lat, rlon, rlat = map(_col, (lon, lat, ref_lon, ref_lat))
    return F.asin(F.sin(lon - rlon) * F.cos(lat)), F.asin(F.sin(lat) * F.cos(rlat) - F.cos(lat) * F.sin(rlat) * F.cos(lon - rlon))


def separation(lon, lat, ref_lon, ref_lat) -> Column:
    """Angle between two directions, by half-angle sines, which keep small angles exact."""
    lon, lat, rlon, rlat = map(_col, (lon, lat, ref_lon, ref_lat))
    h = F.pow(F.sin((lat - rlat) / 2), 2) + F.cos(lat) * F.cos(rlat) * F.pow(F.sin((lon - rlon) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def delay_phasor(freq, metres) -> Cx:
    return Cx.phasor(F.lit(TWO_PI) * _col(freq) * _col(metres) / C_LIGHT)


#: Schwab's rational approximation of the spheroidal of m = 6, alpha = 1, ascending powers.
SPHEROIDAL = (
    (0.75, (8.203343e-2, -3.644705e-1, 6.278660e-1, -5.335581e-1, 2.312756e-1), (1.0, 8.212018e-1, 2.078043e-1)),
    (1.00, (4.028559e-3, -3.697768e-2, 1.021332e-1, -1.201436e-1, 6.412774e-2), (1.0, 9.599102e-1, 2.918724e-1)),
)


def spheroidal(nu) -> Column:
    """The spheroidal of the distance to the edge, 0 outside 0..1."""
    nu = F.abs(_col(nu))
    out = F.when(nu > 1, F.lit(0.0))
    for end, p, q in SPHEROIDAL:
        d = nu * nu - end * end
        out = out.when(nu < end if end < 1 else nu <= end, F.greatest(polynomial(d, p[::-1]) / polynomial(d, q[::-1]), F.lit(0.0)))
    return out


def spheroidal_value(nu: float) -> float:
    """The same for one number, on the driver, where kernel tables are built."""
    nu = abs(nu)
    for end, p, q in SPHEROIDAL:
        if nu < end or nu == end == 1:
            d = nu * nu - end * end
            return max(0.0, sum(c * d**k for k, c in enumerate(p)) / sum(c * d**k for k, c in enumerate(q)))
    return 0.0


def blockage(u, v, w, diam1, diam2) -> tuple[Column, Column]:
    """Shares of two dishes that the other one shades: overlap of circles at the projected distance."""
    u, v, w, d1, d2 = map(_col, (u, v, w, diam1, diam2))
    r1, r2 = F.abs(d1) / 2, F.abs(d2) / 2
    gap = F.sqrt(u * u + v * v)
    # the lens of two circles, from the cosines at the centres
    cut = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    a1, a2 = F.acos(cut((gap * gap + r1 * r1 - r2 * r2) / (2 * gap * r1))), F.acos(cut((gap * gap + r2 * r2 - r1 * r1) / (2 * gap * r2)))
    lens = r1 * r1 * (a1 - F.sin(a1) * F.cos(a1)) + r2 * r2 * (a2 - F.sin(a2) * F.cos(a2))
    apart, inside = gap >= r1 + r2, gap + F.least(r1, r2) <= F.greatest(r1, r2)
    share = lambda own, other: F.when(apart, 0.0).when(inside, F.least(F.lit(1.0), F.pow(other / own, 2))).otherwise(lens / (math.pi * own * own))
    return F.when(w < 0, 0.0).otherwise(share(r1, r2)), F.when(w > 0, 0.0).otherwise(share(r2, r1))


def local_to_global(x, y, z, lon: float, lat: float, origin=(0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """East, north, up metres at a place to earth-centred axes."""
    x, y, z = map(_col, (x, y, z))
    out = math.cos(lat) * z - math.sin(lat) * y
    return math.cos(lon) * out - math.sin(lon) * x + origin[0], math.sin(lon) * out + math.cos(lon) * x + origin[1], math.cos(lat) * y + math.sin(lat) * z + origin[2]


#: Fixed value: Boltzmann's constant in the rounding that the noise figure uses.
BOLTZMANN = 1.38e-23


def thermal_noise(tsys, efficiency, area, bandwidth, seconds) -> Column:
    """Noise of one visibility, Jy."""
    return 1e26 * math.sqrt(2) * BOLTZMANN * _col(tsys) / _col(efficiency) / (_col(area) * F.sqrt(_col(bandwidth) * _col(seconds)))


def taper_sigma(n_pixels, fwhm_pixels) -> Column:
    """Sigma in uv pixels of the Gaussian whose image has that width at half maximum."""
    return _col(n_pixels) / _col(fwhm_pixels) * (4 * math.log(2) / math.pi) / math.sqrt(8 * math.log(2))


def phase_screen(w, x, y) -> Cx:
    """exp(-2 pi i w (1 - sqrt(1 - x^2 - y^2))) for w in wavelengths and direction cosines; 0 beyond the horizon."""
    r2 = _col(x) * _col(x) + _col(y) * _col(y)
    p = Cx.phasor(F.lit(-TWO_PI) * _col(w) * (1 - F.sqrt(F.greatest(1 - r2, F.lit(0.0)))))
    return Cx(F.when(r2 < 1, p.re).otherwise(0.0), F.when(r2 < 1, p.im).otherwise(0.0))


def ionospheric_phase(freq, dx, dy, coeff_l, coeff_m) -> Column:
    """First-order term: -2 pi (dx l + dy m) lambda^2."""
    wave = F.lit(C_LIGHT) / _col(freq)
    return F.lit(-TWO_PI) * (_col(dx) * _col(coeff_l) + _col(dy) * _col(coeff_m)) * wave * wave


def w_power(p, exponent: float) -> Column:
    return F.signum(_col(p)) * F.pow(F.abs(_col(p)), F.lit(exponent))


def w_gaussian_parameters(planes50: float) -> tuple[float, float]:
    """(amplitude, two sigma squared) such that planes50 of the planes hold half of the w range; ends map to ends."""
    if not 0 < planes50 < 1 / math.sqrt(2):
        raise ValueError("the share of planes must lie between 0 and 1/sqrt(2)")
    share = lambda s: math.sqrt(-s * math.log(0.5 + 0.5 * math.exp(-1 / s)))
    low, high = 1e-3, 1e4
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if share(mid) < planes50 else (low, mid)
    return 1 / (1 - math.exp(-1 / low)), low


def w_gaussian(p, amplitude: float, two_sigma2: float) -> Column:
    p = _col(p)
    return F.signum(p) * amplitude * (1 - F.exp(-p * p / two_sigma2))


def w_gaussian_inverse(w, amplitude: float, two_sigma2: float) -> Column:
    w = _col(w)
    return F.when(F.abs(w) == 1, w).otherwise(F.signum(w) * F.sqrt(-F.log(1 - F.abs(w) / amplitude) * two_sigma2))


def frequency_channel(freq, first: float, step: float, n: int) -> Column:
    """Nearest image channel, -1 outside; an image of one channel takes everything."""
    if n == 1:
        return F.lit(0)
    k = nint((_col(freq) - first) / step)
    return F.when((k >= 0) & (k < n), k).otherwise(-1).cast("int")


#: The galactic pole of J2000 (right ascension, declination) and the longitude of the celestial pole, degrees.
GALACTIC = (192.85948, 27.12825, 122.93192)


def galactic(lon, lat) -> tuple[Column, Column]:
    """Galactic longitude and latitude (radians) of a J2000 direction."""
    a, d = _col(lon) - math.radians(GALACTIC[0]), _col(lat)
    pole = math.radians(GALACTIC[1])
    b = F.asin(F.sin(d) * math.sin(pole) + F.cos(d) * math.cos(pole) * F.cos(a))
    turn = math.radians(GALACTIC[2]) - F.atan2(F.cos(d) * F.sin(a), F.sin(d) * math.cos(pole) - F.cos(d) * math.sin(pole) * F.cos(a))
    return F.pmod(turn, F.lit(TWO_PI)), b


def time_text(seconds) -> Column:
    """Seconds since MJD 0 as 17-Nov-1858/00:00:00.0."""
    tenths = F.floor(_col(seconds) * 10 + 0.5).cast("long")
    day, rest = F.floor(tenths / 864000).cast("int"), F.pmod(tenths, F.lit(864000))
    date = F.date_format(F.date_add(F.to_date(F.lit("1858-11-17")), day), "dd-MMM-yyyy")
    return F.format_string("%s/%02d:%02d:%02d.%d", date, F.floor(rest / 36000), F.floor(rest / 600) % 60, F.floor(rest / 10) % 60, rest % 10)


def direction_text(lon, lat) -> Column:
    """A direction (radians) as hh:mm:ss.ss and +dd.mm.ss.ss."""
    hours = F.pmod(F.floor(F.pmod(_col(lon), F.lit(TWO_PI)) * (12 / math.pi * 360000) + 0.5).cast("long"), F.lit(24 * 360000))
    angle = F.floor(F.abs(_col(lat)) * (180 / math.pi * 360000) + 0.5).cast("long")
    parts = lambda n: [F.floor(n / 360000), F.floor(n / 6000) % 60, F.floor(n / 100) % 60, n % 100]
    return F.format_string("%02d:%02d:%02d.%02d %s%02d.%02d.%02d.%02d", *parts(hours), F.when(_col(lat) < 0, "-").otherwise("+"), *parts(angle))


def beam_spectrum_removed(terms: list, log_beam) -> list[Column]:
    """Taylor terms 0 to 2 of images seen through a beam whose width goes with wavelength, without the beam's own spectrum.

    Such a beam is exp(L (1 + x)^2) at the relative frequency offset x, L its
    logarithm at the reference: relative to the reference 1 + 2 L x + (L + 2 L^2) x^2.
    """
    t0, t1, t2 = map(_col, terms)
    big = _col(log_beam)
    first = t1 - 2 * big * t0
    return [t0, first, t2 - 2 * big * first - (big + 2 * big * big) * t0]
