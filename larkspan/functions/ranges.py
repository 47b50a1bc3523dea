"""Range types as struct(lo, hi, lo_inc, hi_inc, empty); a NULL bound is infinite."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col

#: Discrete types are kept as [lo, hi).
DISCRETE = {"int": "int", "bigint": "bigint", "date": "date"}


def build(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, kind: str) -> Column:
    """Canonical range: discrete bounds become [ ), bounds in the wrong order are an error, none between them is empty."""
    lo, hi = lo.cast(kind), hi.cast(kind)
    if kind in DISCRETE:
        step = (lambda c: F.date_add(c, 1)) if kind == "date" else (lambda c: (c + F.lit(1).cast(kind)))
        lo = F.when(lo_inc, lo).otherwise(step(lo))
        hi = F.when(hi_inc, step(hi)).otherwise(hi)
        lo_inc, hi_inc = lo.isNotNull(), F.lit(False)
    empty = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
    null = F.lit(None).cast(kind)
    return F.struct(
        F.when(~empty, lo).otherwise(null).alias("lo"),
        F.when(~empty, hi).otherwise(null).alias("hi"),
        (~empty & lo_inc & lo.isNotNull()).alias("lo_inc"),
        (~empty & hi_inc & hi.isNotNull()).alias("hi_inc"),
        empty.alias("empty"),
    )


def make(lo, hi, kind: str, bounds: str = "[)") -> Column:
    """int4range(lo, hi, bounds) and its like; `kind` is the Spark type of the bounds."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    lo, hi = (c(x) for x in (lo, hi))
    fault = F.when(lo.cast(kind) > hi.cast(kind), F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast(kind)).otherwise(lo.cast(kind))
    return build(fault, hi, F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"), kind)


def literal(text: str, kind: str) -> Column:
    """'[a,b)', '(a,]', 'empty' as a range."""
    t = text.strip()
    if t.lower() == "empty":
        null, no = F.lit(None).cast(kind), F.lit(False)
        return F.struct(null.alias("lo"), null.alias("hi"), no.alias("lo_inc"), no.alias("hi_inc"), F.lit(True).alias("empty"))
    m = re.fullmatch(r"([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])", t)
    if not m:
        raise ValueError(f'malformed range literal: "{text}"')
    value = lambda s: F.lit(s.strip('"') if s else None).cast(kind)
    return make(value(m[2]), value(m[3]), kind, m[1] + m[4])


def from_text(s, kind: str) -> Column:
    """A column of range literals; malformed text is NULL."""
    s = F.trim(col(s))
    p = r"^([\[(])\s*\"?([^,\"]*?)\"?\s*,\s*\"?([^,\"]*?)\"?\s*([\])])$"
    part = lambda i: F.nullif(F.regexp_extract(s, p, i), F.lit("")).try_cast(kind)
    r = build(part(2), part(3), F.regexp_extract(s, p, 1) == "[", F.regexp_extract(s, p, 4) == "]", kind)
    return F.when(F.lower(s) == "empty", literal("empty", kind)).when(s.rlike(p), r)


def to_text(r) -> Column:
    r = col(r)
    bound = lambda b: F.coalesce(b.cast("string"), F.lit(""))
    return F.when(r["empty"], "empty").otherwise(F.concat(F.when(r["lo_inc"], "[").otherwise("("), bound(r["lo"]), F.lit(","), bound(r["hi"]), F.when(r["hi_inc"], "]").otherwise(")")))


def contains_elem(r, e) -> Column:
    """r @> element."""
    r, e = col(r), e if isinstance(e, Column) else F.lit(e)
    return ~r["empty"] & (r["lo"].isNull() | (r["lo"] < e) | (r["lo_inc"] & (r["lo"] == e))) & (r["hi"].isNull() | (e < r["hi"]) | (r["hi_inc"] & (e == r["hi"])))


def _lo_before(a, b) -> Column:
    """a's lower bound is at or before b's."""
    return a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])), F.lit(False))


def _hi_before(a, b) -> Column:
    """a's upper bound is at or before b's."""
    return b["hi"].isNull() | F.coalesce((a["hi"] < b["hi"]) | ((a["hi"] == b["hi"]) & (b["hi_inc"] | ~a["hi_inc"])), F.lit(False))


def contains(a, b) -> Column:
    """a @> b; the empty range is in every range."""
    a, b = col(a), col(b)
    return b["empty"] | (~a["empty"] & _lo_before(a, b) & _hi_before(b, a))


def contained(a, b) -> Column:
    return contains(b, a)


def left_of(a, b) -> Column:
    """a << b."""
    a, b = col(a), col(b)
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))


def right_of(a, b) -> Column:
    return left_of(b, a)


def overlaps(a, b) -> Column:
    """a && b."""
    return ~col(a)["empty"] & ~col(b)["empty"] & ~left_of(a, b) & ~left_of(b, a)


def adjacent(a, b) -> Column:
    """a -|- b: one's end is the other's begin, and just one of them has it."""
    a, b = col(a), col(b)
    touch = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def not_right(a, b) -> Column:
    """a &< b: a does not extend to the right of b."""
    a, b = col(a), col(b)
    return ~a["empty"] & ~b["empty"] & _hi_before(a, b)


def not_left(a, b) -> Column:
    """a &> b: a does not extend to the left of b."""
    a, b = col(a), col(b)
    return ~a["empty"] & ~b["empty"] & _lo_before(b, a)


def lower(r) -> Column:
    return col(r)["lo"]


def upper(r) -> Column:
    return col(r)["hi"]


def lower_inc(r) -> Column:
    return col(r)["lo_inc"]


def upper_inc(r) -> Column:
    return col(r)["hi_inc"]


def lower_inf(r) -> Column:
    return ~col(r)["empty"] & col(r)["lo"].isNull()


def upper_inf(r) -> Column:
    return ~col(r)["empty"] & col(r)["hi"].isNull()


def is_empty(r) -> Column:
    return col(r)["empty"]
