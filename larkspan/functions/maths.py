"""PostgreSQL numeric semantics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def log(x, base=None) -> Column:
    """log(x) to base 10; log(b, x) to base b."""
    return F.log10(col(x)) if base is None else F.ln(col(x)) / F.ln(col(base) if not isinstance(base, (int, float)) else F.lit(base))


def ln(x) -> Column:
    return F.ln(col(x))


def power(x, y) -> Column:
    return F.pow(col(x), col(y) if not isinstance(y, (int, float)) else F.lit(y))


def int_div(a, b) -> Column:
    """a / b of integers, and div(): truncates toward zero."""
    return F.call_function("try_divide", col(a).cast("decimal(38,0)"), col(b).cast("decimal(38,0)")).cast("long")


def mod(a, b) -> Column:
    """a % b with the sign of a."""
    return col(a) % col(b)


def trunc(x, places: int = 0) -> Column:
    """trunc(): toward zero, also for negative numbers and places."""
    scale = 10.0**places
    return F.signum(col(x)) * F.floor(F.abs(col(x)) * scale) / scale


def round_binary(x, places: int = 0) -> Column:
    """round() of doubles as binary numbers: half away from zero after scaling, the sign of zero stays."""
    scale = 10.0**places
    y = F.abs(col(x)) * scale
    return F.signum(col(x)) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / scale


def width_bucket(x, lo, hi, n: int) -> Column:
    """width_bucket(): 0 below, n + 1 from hi on; works with bounds in falling order too."""
    x, lo, hi = col(x).cast("double"), F.lit(float(lo)), F.lit(float(hi))
    up = F.when(x < lo, 0).when(x >= hi, n + 1).otherwise(F.floor((x - lo) / (hi - lo) * n) + 1)
    down = F.when(x > lo, 0).when(x <= hi, n + 1).otherwise(F.floor((lo - x) / (lo - hi) * n) + 1)
    return F.when(lo < hi, up).otherwise(down).cast("int")


def trim_scale(x) -> Column:
    """trim_scale(): the number as text without trailing zeros of its fraction."""
    return F.regexp_replace(F.regexp_replace(col(x).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def is_finite(x) -> Column:
    """False for NaN and the infinities."""
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def parse_float(s) -> Column:
    """Text to double with NaN, Infinity and -Infinity in any case; other text that is no number is NULL."""
    t = F.lower(F.trim(col(s)))
    special = F.when(t == "nan", F.lit(float("nan"))).when(t.isin("infinity", "inf", "+infinity", "+inf"), F.lit(float("inf"))).when(t.isin("-infinity", "-inf"), F.lit(float("-inf")))
    return F.coalesce(special, t.try_cast("double"))


def parse_bool(s) -> Column:
    """Text to boolean by every prefix of true, yes, on, false, no, off, and 1 and 0; other text is an error."""
    t = F.lower(F.trim(col(s)))
    prefixes = lambda words: sorted({w[:i] for w in words for i in range(1, len(w) + 1)} - {"o"})
    yes, no = [*prefixes(("true", "yes", "on")), "1"], [*prefixes(("false", "no", "off")), "0"]
    bad = F.raise_error(F.concat(F.lit('invalid input syntax for type boolean: "'), col(s), F.lit('"'))).cast("boolean")
    return F.when(t.isin(yes), True).when(t.isin(no), False).when(t.isNotNull(), bad)


def is_valid_input(s, kind: str) -> Column:
    """pg_input_is_valid(): can the text be read as the type?"""
    spark = {"int2": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "float4": "float", "float8": "double", "bool": "boolean", "numeric": "decimal(38,10)", "timestamptz": "timestamp"}.get(kind, kind)
    return F.trim(col(s)).try_cast(spark).isNotNull()


def float8_accum(x) -> Column:
    """Aggregate state {n, sum, sum of squares} of the non-null values."""
    x = col(x).cast("double")
    return F.array(F.count(x).cast("double"), F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.sum(x * x), F.lit(0.0)))


def float8_combine(a, b) -> Column:
    """Two such states as one."""
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def float8_regr_accum(y, x) -> Column:
    """Aggregate state {n, sum x, sum x^2, sum y, sum y^2, sum xy} of the pairs without NULL."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    pick = lambda v: F.coalesce(F.sum(F.when(both, v)), F.lit(0.0))
    return F.array(F.count(F.when(both, x)).cast("double"), pick(x), pick(x * x), pick(y), pick(y * y), pick(x * y))
