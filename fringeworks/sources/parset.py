"""key = value configuration: scalars, [vectors], quantities with units."""

from __future__ import annotations

import datetime
import math
import re

#: Units in SI (angles in radians).
UNITS = {
    "deg": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000, "mas": math.pi / 648000000, "rad": 1.0,
    "Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "m": 1.0, "km": 1e3, "cm": 0.01, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0,
    "Jy": 1.0, "mJy": 1e-3, "uJy": 1e-6, "%": 0.01, "km/s": 1e3, "m/s": 1.0, "K": 1.0,
}
_NUMBER = re.compile(r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z%/]*)$")


def quantity(text: str, kind: str | None = None) -> float:
    """A number with an optional unit, in SI. kind names a unit it must be convertible to, such as "arcsec"."""
    m = _NUMBER.match(text.strip().strip('"'))
    if not m or m[2] and m[2] not in UNITS:
        raise ValueError(f"not a quantity: {text!r}")
    if kind and m[2] and _dimension(m[2]) != _dimension(kind):
        raise ValueError(f"{text!r} is not convertible to {kind}")
    return float(m[1]) * UNITS.get(m[2], 1.0)


_CLOCK = r"(?:[/T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?Z?$"
_NUMERIC = re.compile(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _CLOCK)
_NAMED = re.compile(r"^(\d{1,2})[-/ ]?([A-Za-z]{3,9})[-/ ]?(\d{4})" + _CLOCK)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def moment(text: str | float) -> float:
    """Seconds since MJD 0 of a time: 2024-01-05/10:30:00, 2024-01-05T10:30, 5jan2024/10:30:00.5, 5-Jan-2024; else a quantity (60314.5d, or seconds)."""
    t = str(text).strip().strip('"')
    if m := _NUMERIC.match(t):
        year, month, day = int(m[1]), int(m[2]), int(m[3])
    elif m := _NAMED.match(t):
        if m[2][:3].lower() not in _MONTHS:
            raise ValueError(f"not a month: {m[2]!r}")
        year, month, day = int(m[3]), _MONTHS.index(m[2][:3].lower()) + 1, int(m[1])
    else:
        return quantity(t, "s")
    hour, minute, second = int(m[4] or 0), int(m[5] or 0), float(m[6] or 0)
    if hour > 23 or minute > 59 or second >= 60:
        raise ValueError(f"not a time of day: {text!r}")
    return (datetime.date(year, month, day) - datetime.date(1858, 11, 17)).days * 86400.0 + hour * 3600 + minute * 60 + second


def _dimension(unit: str) -> str:
    for name, members in {"angle": "deg arcmin arcsec mas rad", "frequency": "Hz kHz MHz GHz", "length": "m km cm", "time": "s min h d", "flux": "Jy mJy uJy", "ratio": "%", "speed": "km/s m/s", "temperature": "K"}.items():
        if unit in members.split():
            return name
    return unit


def value(text: str):
    """bool, int, float, list or string, as the text reads."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        return [value(x) for x in _split(t[1:-1])]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def _split(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part] if part.strip() else out


def parse(text: str) -> dict:
    """All keys; # begins a comment, a trailing backslash goes on with the next line."""
    out = {}
    for line in text.replace("\\\n", " ").splitlines():
        line = line.split("#", 1)[0].strip()
        if "=" in line:
            key, raw = line.split("=", 1)
            out[key.strip()] = value(raw)
    return out


def subset(parset: dict, prefix: str) -> dict:
    return {k[len(prefix) :]: v for k, v in parset.items() if k.startswith(prefix)}


def selection(parset: dict):
    """A predicate builder from selection keys: beams, scans, fields, channels, and timerange or timebegin and timeend, which moment() reads."""
    from ..operators.select import split_rows

    begin, end = (None if t is None else moment(t) for t in parset.get("timerange", [parset.get("timebegin"), parset.get("timeend")]))
    if begin is not None and end is not None and begin > end:
        raise ValueError("the time range ends before it begins")
    first, n = parset.get("channels", [None, None])

    def apply(vis):
        out = split_rows(vis, begin, end, parset.get("scans", ()), parset.get("fields", ()), parset.get("beams", ()))
        return out if first is None else out.where(f"chan BETWEEN {int(first)} AND {int(first) + int(n) - 1}")

    return apply


def antennas(parset: dict) -> list[dict]:
    """name, x, y, z (metres, scaled), diameter, mount of an array definition: antennas.telescope names the subset that holds the rest."""
    own = subset(parset, f"antennas.{parset['antennas.telescope']}.")
    mount, frame = own.get("mount", "equatorial"), own.get("coordinates", "local")
    if not own.get("names") or mount not in ("equatorial", "alt-az") or frame not in ("local", "global"):
        raise ValueError("an array needs names, a mount of equatorial or alt-az, and local or global coordinates")
    diameter, scale = quantity(str(own.get("diameter", "12m")), "m"), float(own.get("scale", 1.0))
    if diameter <= 0:
        raise ValueError("the diameter is not positive")
    return [{"antenna": i, "name": str(n), **dict(zip("xyz", (scale * float(v) for v in own[str(n)]), strict=True)), "diameter": diameter, "mount": mount} for i, n in enumerate(own["names"])]


def feeds(parset: dict) -> list[dict]:
    """name, x, y (radians if feeds.spacing is given) and polarisations of the feeds."""
    names = parset.get("feeds.names")
    if not names:
        raise ValueError("no feeds")
    scale = quantity(str(parset["feeds.spacing"]), "rad") if "feeds.spacing" in parset else 1.0
    return [{"feed": i, "name": str(n), "x": scale * float(parset[f"feeds.{n}"][0]), "y": scale * float(parset[f"feeds.{n}"][1]), "pol": "X Y"} for i, n in enumerate(names)]


def spectral_windows(parset: dict) -> list[dict]:
    """name, n_chan, first and step (Hz), polarisations: lists such as [16, 1.3GHz, -1MHz, "XX YY"]."""
    out = []
    for i, n in enumerate(parset.get("spws.names", [])):
        count, first, step, pols = parset[f"spws.{n}"]
        out.append({"spw": i, "name": str(n), "n_chan": int(count), "first": quantity(str(first), "Hz"), "step": quantity(str(step), "Hz"), "pol": str(pols)})
    return out


def sources(parset: dict) -> list[dict]:
    """name, and right ascension, declination and frame as they are written."""
    return [{"field": i, "name": str(n), "ra": str(d[0]), "dec": str(d[1]), "frame": str(d[2]) if len(d) > 2 else "J2000"} for i, n in enumerate(parset.get("sources.names", [])) for d in [parset[f"sources.{n}.direction"]]]
