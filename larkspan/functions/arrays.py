"""PostgreSQL array semantics as Column expressions; NULL elements equal each other in set operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def parse_literal(text: str) -> list:
    """A '{...}' literal (or JSON array) as nested lists of str or None."""
    text = text.strip()
    if text.startswith("["):
        import json

        return json.loads(text)
    at = 0

    def item():
        nonlocal at
        if text[at] == "{":
            at += 1
            out = []
            while text[at] != "}":
                out.append(item())
                if text[at] == ",":
                    at += 1
            at += 1
            return out
        if text[at] == '"':
            at += 1
            s = ""
            while text[at] != '"':
                at += text[at] == "\\"
                s += text[at]
                at += 1
            at += 1
            return s
        begin = at
        while text[at] not in ",}":
            at += 1
        s = text[begin:at].strip()
        return None if s.upper() == "NULL" else s

    try:
        if not text.startswith("{"):
            raise IndexError
        out = item()
    except IndexError:
        raise ValueError(f'malformed array literal: "{text}"') from None
    if at != len(text):
        raise ValueError(f'malformed array literal: "{text}"')
    return out


def literal(text: str, kind: str = "string") -> Column:
    """A '{...}' literal as an array of the Spark type `kind`."""
    def build(v):
        return F.array(*[build(x) for x in v]) if isinstance(v, list) else F.lit(v).cast(kind)

    return build(parse_literal(text))


def overlap(a, b) -> Column:
    """a && b."""
    return F.size(F.array_intersect(col(a), col(b))) > 0


def contains(a, b) -> Column:
    """a @> b."""
    return F.size(F.array_except(col(b), col(a))) == 0


def contained(a, b) -> Column:
    """a <@ b."""
    return contains(b, a)


def any_(value, op: str, a) -> Column:
    """value op ANY (array), three-valued."""
    v = _value(value)
    return F.exists(col(a), lambda x: _compare(v, op, x))


def all_(value, op: str, a) -> Column:
    """value op ALL (array), three-valued; true for an empty array."""
    v = _value(value)
    return F.forall(col(a), lambda x: _compare(v, op, x))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def append(a, value) -> Column:
    return F.concat(F.coalesce(col(a), F.array()), F.array(_value(value)))


def prepend(value, a) -> Column:
    return F.concat(F.array(_value(value)), F.coalesce(col(a), F.array()))


def cat(a, b) -> Column:
    """array_cat(): a NULL array counts as absent."""
    a, b = col(a), col(b)
    return F.coalesce(F.concat(a, b), a, b)


def remove(a, value) -> Column:
    v = _value(value)
    return F.filter(col(a), lambda x: ~x.eqNullSafe(v))


def replace(a, old, new) -> Column:
    o, n = _value(old), _value(new)
    return F.transform(col(a), lambda x: F.when(x.eqNullSafe(o), n).otherwise(x))


def length(a, dim: int = 1) -> Column:
    """array_length(): NULL if empty or without that dimension."""
    a = col(a)
    for _ in range(dim - 1):
        a = F.get(a, F.lit(0))
    return F.nullif(F.when(a.isNotNull(), F.size(a)), F.lit(0))


def cardinality(a, dims: int = 1) -> Column:
    a = col(a)
    for _ in range(dims - 1):
        a = F.flatten(a)
    return F.when(a.isNotNull(), F.size(a))


def lower(a, dim: int = 1) -> Column:
    return F.when(length(a, dim).isNotNull(), F.lit(1))


def upper(a, dim: int = 1) -> Column:
    return length(a, dim)


def ndims(a, dims: int = 1) -> Column:
    return F.when(F.size(col(a)) > 0, F.lit(dims))


def dims(a, n: int = 1) -> Column:
    """array_dims(): '[1:n][1:m]'."""
    return F.when(F.size(col(a)) > 0, F.concat(*[F.concat(F.lit("[1:"), length(a, k).cast("string"), F.lit("]")) for k in range(1, n + 1)]))


def position(a, value, start: int = 1) -> Column:
    """array_position(): the first place from start on, NULL if none; finds NULL too."""
    return F.get(F.filter(positions(a, value), lambda i: i >= start), F.lit(0))


def positions(a, value) -> Column:
    v = _value(value)
    return F.filter(F.transform(col(a), lambda x, i: F.when(x.eqNullSafe(v), i + 1)), lambda i: i.isNotNull())


def to_string(a, delimiter: str, null: str | None = None) -> Column:
    """array_to_string(): NULL elements are left out unless a text for them is given."""
    return F.array_join(col(a), delimiter) if null is None else F.array_join(col(a), delimiter, null)


def from_string(s, delimiter: str | None, null: str | None = None) -> Column:
    """string_to_array(): an empty delimiter gives the whole text, NULL its characters; an empty text is an empty array."""
    s = col(s)
    if delimiter is None:
        parts = F.filter(F.split(s, "", -1), lambda x: x != "")
    elif delimiter == "":
        parts = F.array(s)
    else:
        parts = F.split(s, r"\Q" + delimiter + r"\E", -1)
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
    return parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))


def fill(value, shape: list[int]) -> Column:
    out = _value(value)
    for n in reversed(shape):
        out = F.array_repeat(out, n)
    return out


def trim(a, n: int) -> Column:
    """trim_array(): without the last n elements."""
    a = col(a)
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def sort(a, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """array_sort(): NULLs last ascending and first descending unless told otherwise."""
    a = col(a)
    first = descending if nulls_first is None else nulls_first
    values = F.sort_array(F.filter(a, lambda x: x.isNotNull()), asc=not descending)
    nulls = F.filter(a, lambda x: x.isNull())
    return F.concat(nulls, values) if first else F.concat(values, nulls)


def reverse(a) -> Column:
    return F.reverse(col(a))


def shuffle(a) -> Column:
    return F.shuffle(col(a))


def sample(a, n: int) -> Column:
    return F.slice(F.shuffle(col(a)), 1, n)


def to_json(a) -> Column:
    return F.to_json(col(a), {"ignoreNullFields": "false"})


def subscript(a, i) -> Column:
    """a[i], from 1; NULL outside."""
    i = _value(i)
    return F.when(i >= 1, F.get(col(a), i - 1))


def slice_(a, lo: int, hi: int) -> Column:
    """a[lo:hi], both included."""
    lo = max(lo, 1)
    return F.slice(col(a), lo, max(hi - lo + 1, 0))
