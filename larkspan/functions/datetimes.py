"""PostgreSQL date and time semantics as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def _ntz(x) -> Column:
    return col(x).cast("timestamp_ntz")


def _january(year: Column) -> Column:
    return F.to_timestamp_ntz(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))


def date_trunc(field: str, ts) -> Column:
    """date_trunc() with centuries and millennia from year 1 on, decades by their first digits."""
    ts, field = _ntz(ts), field.lower().rstrip("s") if field.lower() not in ("centuries", "millennia") else {"centuries": "century", "millennia": "millennium"}[field.lower()]
    year = F.year(ts)
    if field == "decade":
        return _january(year - year % 10)
    if field in ("century", "millennium"):
        span = 100 if field == "century" else 1000
        return _january(F.floor((year - 1) / span) * span + 1)
    return F.date_trunc(field, ts).cast("timestamp_ntz")


def date_trunc_tz(field: str, ts, zone: str) -> Column:
    """date_trunc(field, timestamptz, zone): truncated by that zone's clock."""
    ts = col(ts).cast("timestamp")
    return F.to_utc_timestamp(F.date_trunc(field, F.from_utc_timestamp(ts, zone)), zone)


def date_part(field: str, ts) -> Column:
    """date_part() / extract() as double: dow has Sunday 0, isodow Monday 1, week and isoyear are ISO's."""
    ts, field = _ntz(ts), field.lower()
    utc = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), ts)
    micros = F.unix_micros(ts.cast("timestamp"))
    year = F.year(ts)
    second = F.second(ts) + (F.pmod(micros, F.lit(1_000_000)) / 1_000_000)
    table = {
        "dow": F.dayofweek(ts) - 1,
        "isodow": F.weekday(ts) + 1,
        "doy": F.dayofyear(ts),
        "week": F.weekofyear(ts),
        "isoyear": F.extract(F.lit("YEAROFWEEK"), utc),
        "epoch": micros / 1_000_000,
        "julian": F.datediff(ts.cast("date"), F.lit("2000-01-01").cast("date")) + 2451545 + F.pmod(micros, F.lit(86_400_000_000)) / 86_400_000_000,
        "decade": F.floor(year / 10),
        "century": F.floor((year + 99) / 100),
        "millennium": F.floor((year + 999) / 1000),
        "year": year,
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": second,
        "milliseconds": second * 1000,
        "microseconds": second * 1_000_000,
    }
    if field not in table:
        raise ValueError(f'unit "{field}" not recognized')
    return table[field].cast("double")


_UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800}


def _stride_micros(stride: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", stride.lower())
    if not m or m[2] not in _UNITS:
        raise ValueError(f"a stride of seconds to weeks is needed, not {stride!r}")
    return int(m[1]) * _UNITS[m[2]] * 1_000_000


def date_bin(stride: str, ts, origin: str = "2000-01-01 00:00:00") -> Column:
    """date_bin(): the start of the bin, also before the origin."""
    step = _stride_micros(stride)
    t = F.unix_micros(_ntz(ts).cast("timestamp"))
    o = F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(t - F.pmod(t - o, F.lit(step))).cast("timestamp_ntz")


def age(a, b) -> Column:
    """age(a, b) as struct(months, days, micros): whole months first, then days and time, all of one sign."""
    a, b = _ntz(a), _ntz(b)
    back = a < b
    hi, lo = F.when(back, b).otherwise(a), F.when(back, a).otherwise(b)
    clock = lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000))
    borrow_day = (clock(hi) < clock(lo)).cast("int")
    micros = clock(hi) - clock(lo) + borrow_day * F.lit(86_400_000_000)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow_day
    short = (days < 0).cast("int")
    # a borrowed month has as many days as the earlier date's month
    days = days + short * F.dayofmonth(F.last_day(lo))
    sign = F.when(back, -1).otherwise(1)
    return F.struct((sign * (months - short)).cast("int").alias("months"), (sign * days).cast("int").alias("days"), (sign * micros).cast("long").alias("micros"))


def to_timestamp(epoch) -> Column:
    """to_timestamp(double): seconds since 1970."""
    return F.timestamp_micros(F.round(col(epoch).cast("double") * 1_000_000).cast("long"))


#: Template patterns and their Java counterparts, longest first.
_PATTERNS = (("YYYY", "yyyy"), ("Month", "MMMM"), ("MONTH", "MMMM"), ("HH24", "HH"), ("HH12", "hh"), ("Mon", "MMM"), ("MON", "MMM"), ("DDD", "DDD"), ("HH", "hh"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Day", "EEEE"), ("Dy", "EEE"))


def java_pattern(fmt: str) -> str:
    """A to_char / to_date template as a datetime pattern."""
    out, i = "", 0
    while i < len(fmt):
        hit = next(((p, j) for p, j in _PATTERNS if fmt.startswith(p, i)), None)
        if hit:
            out += hit[1]
            i += len(hit[0])
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def to_date(s, fmt: str) -> Column:
    """to_date(text, template); text that does not fit is NULL."""
    return F.try_to_timestamp(col(s), F.lit(java_pattern(fmt))).cast("date")


def to_char(ts, fmt: str) -> Column:
    """to_char(timestamp, template)."""
    return F.date_format(col(ts), java_pattern(fmt))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(*[F.lit(x) if isinstance(x, int) else col(x) for x in (y, mo, d, h, mi)], F.lit(s) if isinstance(s, (int, float)) else col(s))


def at_time_zone(ts, zone: str) -> Column:
    """timestamp AT TIME ZONE zone for a timestamp with zone: that zone's clock."""
    m = re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", zone)
    zone = f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}" if m else {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "CET": "+01:00", "CEST": "+02:00", "BST": "+01:00", "IST": "+05:30", "JST": "+09:00"}.get(zone.upper(), zone)
    return F.from_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")
