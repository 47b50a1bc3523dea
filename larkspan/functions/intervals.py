"""The interval type: struct(months int, days int, micros long), compared by 30-day months."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col

DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
#: Unit names (months, days, micros of one).
_UNITS = {
    "millennium": (12_000, 0, 0), "millennia": (12_000, 0, 0), "century": (1200, 0, 0), "centuries": (1200, 0, 0), "decade": (120, 0, 0),
    "year": (12, 0, 0), "yr": (12, 0, 0), "y": (12, 0, 0), "month": (1, 0, 0), "mon": (1, 0, 0), "week": (0, 7, 0), "w": (0, 7, 0), "day": (0, 1, 0), "d": (0, 1, 0),
    "hour": (0, 0, HOUR), "hr": (0, 0, HOUR), "h": (0, 0, HOUR), "minute": (0, 0, MINUTE), "min": (0, 0, MINUTE), "m": (0, 0, MINUTE),
    "second": (0, 0, SECOND), "sec": (0, 0, SECOND), "s": (0, 0, SECOND), "millisecond": (0, 0, 1000), "ms": (0, 0, 1000), "microsecond": (0, 0, 1), "us": (0, 0, 1),
}


def _spread(amount: float, unit: tuple[int, int, int]) -> tuple[float, float, float]:
    """Fractions of months go to days of 30, fractions of days to time."""
    months, days, micros = amount * unit[0], amount * unit[1], amount * unit[2]
    whole = int(months)
    days += (months - whole) * 30
    whole_days = int(days + (1e-9 if days > 0 else -1e-9))
    return whole, whole_days, micros + (days - whole_days) * DAY


def parse(text: str) -> tuple[int, int, int]:
    """(months, days, micros) of an interval literal: verbose, HH:MM:SS, ISO 8601, with `ago`."""
    s = text.strip().lower()
    total = [0.0, 0.0, 0.0]

    def add(parts, sign=1):
        for k in range(3):
            total[k] += sign * parts[k]

    iso = re.fullmatch(r"p(?=.)((?:-?[\d.]+[ymwd])*)(?:t((?:-?[\d.]+[hms])+))?", s)
    if iso:
        for n, u in re.findall(r"(-?[\d.]+)([ymwd])", iso[1] or ""):
            add(_spread(float(n), _UNITS["mon" if u == "m" else u]))
        for n, u in re.findall(r"(-?[\d.]+)([hms])", iso[2] or ""):
            add(_spread(float(n), _UNITS[u]))
    else:
        ago = s.endswith(" ago")
        rest = s.removesuffix(" ago").removeprefix("@").strip()
        token = re.compile(r"\s*(?:([+-]?)(\d+):(\d{2})(?::(\d{2}(?:\.\d+)?))?|([+-]?\d*\.?\d+)\s*([a-z]+)|([+-]?\d*\.?\d+)$)")
        at = 0
        while at < len(rest):
            m = token.match(rest, at)
            if not m:
                raise ValueError(f'invalid input syntax for type interval: "{text}"')
            if m[2]:
                add((0, 0, int(m[2]) * HOUR + int(m[3]) * MINUTE + float(m[4] or 0) * SECOND), -1 if m[1] == "-" else 1)
            else:
                unit = m[6] or "second"
                unit = unit if unit in _UNITS else unit.removesuffix("s")
                if unit not in _UNITS:
                    raise ValueError(f'invalid input syntax for type interval: "{text}"')
                add(_spread(float(m[5] or m[7]), _UNITS[unit]))
            at = m.end()
            while at < len(rest) and rest[at].isspace():
                at += 1
        if not rest:
            raise ValueError(f'invalid input syntax for type interval: "{text}"')
        if ago:
            total = [-x for x in total]
    return int(total[0]), int(round(total[1])), int(round(total[2]))


def build(months, days, micros) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def literal(text: str) -> Column:
    return build(*[F.lit(x) for x in parse(text)])


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0.0) -> Column:
    v = [F.lit(x) if isinstance(x, (int, float)) else col(x) for x in (years, months, weeks, days, hours, mins, secs)]
    return build(v[0] * 12 + v[1], v[2] * 7 + v[3], v[4] * HOUR + v[5] * MINUTE + F.round(v[6] * SECOND))


def add(a, b) -> Column:
    a, b = col(a), col(b)
    return build(*[a[f] + b[f] for f in ("months", "days", "micros")])


def sub(a, b) -> Column:
    a, b = col(a), col(b)
    return build(*[a[f] - b[f] for f in ("months", "days", "micros")])


def neg(a) -> Column:
    a = col(a)
    return build(*[-a[f] for f in ("months", "days", "micros")])


def mul(a, factor: float) -> Column:
    """Fractions of months and days are handed down to days and time."""
    a = col(a)
    months = a["months"] * float(factor)
    whole = F.signum(months) * F.floor(F.abs(months))
    days = a["days"] * float(factor) + (months - whole) * 30
    whole_days = F.signum(days) * F.floor(F.abs(days) + 1e-9)
    return build(whole, whole_days, F.round(a["micros"] * float(factor) + (days - whole_days) * DAY))


def div(a, divisor: float) -> Column:
    if divisor == 0:
        raise ZeroDivisionError("division by zero")
    return mul(a, 1.0 / divisor)


def total_micros(a) -> Column:
    """The order of intervals: a month has 30 days, a day 24 hours."""
    a = col(a)
    return (a["months"].cast("decimal(38,0)") * 30 + a["days"]) * DAY + a["micros"]


def compare(a, op: str, b) -> Column:
    """a op b for = <> < <= > >=."""
    x, y = total_micros(a), total_micros(b)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def extract(field: str, a) -> Column:
    """extract(field from interval) as double; epoch counts a year as 365.25 days and a month as 30."""
    a = col(a)
    table = {
        "year": F.signum(a["months"]) * F.floor(F.abs(a["months"]) / 12),
        "month": a["months"] % 12,
        "day": a["days"],
        "hour": F.signum(a["micros"]) * F.floor(F.abs(a["micros"]) / HOUR),
        "minute": F.signum(a["micros"]) * F.floor(F.abs(a["micros"]) % HOUR / MINUTE),
        "second": a["micros"] % MINUTE / SECOND,
        "epoch": F.signum(a["months"]) * F.floor(F.abs(a["months"]) / 12) * 31_557_600 + (a["months"] % 12) * 2_592_000 + a["days"] * 86400 + a["micros"] / SECOND,
    }
    return table[field.lower()].cast("double")


def justify_hours(a) -> Column:
    a = col(a)
    days = F.signum(a["micros"]) * F.floor(F.abs(a["micros"]) / DAY)
    return build(a["months"], a["days"] + days, a["micros"] - days * DAY)


def justify_days(a) -> Column:
    a = col(a)
    months = F.signum(a["days"]) * F.floor(F.abs(a["days"]) / 30)
    return build(a["months"] + months, a["days"] - months * 30, a["micros"])


def justify_interval(a) -> Column:
    """Both, then signs made alike."""
    t = total_micros(a)
    s, u = F.signum(t), F.abs(t)
    months = F.floor(u / (30 * DAY))
    days = F.floor((u - months * 30 * DAY) / DAY)
    return build(s * months, s * days, s * (u - months * 30 * DAY - days * DAY))


def plus(ts, a, sign: int = 1) -> Column:
    """timestamp + interval (or - with sign -1): months by the calendar, then days, then time."""
    a = col(a)
    t = col(ts).cast("timestamp_ntz")
    step = lambda y, mo, w, d, h, mi, s: F.make_interval(y, mo, w, d, h, mi, s)
    z = F.lit(0)
    return t + step(z, a["months"] * sign, z, a["days"] * sign, z, z, (a["micros"] * sign / SECOND).cast("decimal(18,6)"))


def to_text(a) -> Column:
    """The interval as text: `1 year 2 mons 3 days 04:05:06`."""
    a = col(a)
    y, m = F.signum(a["months"]) * F.floor(F.abs(a["months"]) / 12), a["months"] % 12
    part = lambda v, one, many: F.when(v != 0, F.concat(v.cast("long").cast("string"), F.when(F.abs(v) == 1, one).otherwise(many)))
    u = F.abs(a["micros"])
    two = lambda v: F.lpad(v.cast("long").cast("string"), 2, "0")
    frac = u % SECOND
    clock = F.concat(F.when(a["micros"] < 0, "-").otherwise(""), two(F.floor(u / HOUR)), F.lit(":"), two(F.floor(u % HOUR / MINUTE)), F.lit(":"), two(F.floor(u % MINUTE / SECOND)), F.when(frac > 0, F.regexp_replace(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")), "0+$", "")).otherwise(""))
    nothing = (a["months"] == 0) & (a["days"] == 0)
    return F.concat_ws(" ", part(y, " year", " years"), part(m, " mon", " mons"), part(a["days"], " day", " days"), F.when((a["micros"] != 0) | nothing, clock))
