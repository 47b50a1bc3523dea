"""Vector distances over array columns, computed in double by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def vec(x) -> Column:
    """A column, a list of numbers or a '[1,2]' literal as array<double>."""
    if isinstance(x, list):
        return F.array(*[F.lit(float(v)) for v in x])
    if isinstance(x, str) and x.strip().startswith("["):
        return vec([float(v) for v in x.strip().strip("[]").split(",") if v.strip()])
    return col(x).cast("array<double>")


def _same(a: Column, b: Column, value: Column) -> Column:
    fault = F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(fault).cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def inner_product(a, b) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def negative_inner_product(a, b) -> Column:
    """a <#> b, smaller for nearer vectors."""
    return -inner_product(a, b)


def l2_distance(a, b) -> Column:
    """a <-> b."""
    a, b = vec(a), vec(b)
    return _same(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def l1_distance(a, b) -> Column:
    """a <+> b."""
    a, b = vec(a), vec(b)
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(vec(a), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    """a <=> b: 1 less the cosine, which is kept in [-1, 1]; NULL for a zero vector."""
    norm = l2_norm(a) * l2_norm(b)
    return F.when(norm > 0, 1 - F.greatest(F.least(inner_product(a, b) / norm, F.lit(1.0)), F.lit(-1.0)))


def l2_normalize(a) -> Column:
    n = l2_norm(a)
    return F.transform(vec(a), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def dims(a) -> Column:
    return F.size(vec(a))


def subvector(a, start: int, length: int) -> Column:
    return F.slice(vec(a), start, length)


def add(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x - y)


def mul(a, k: float) -> Column:
    return F.transform(vec(a), lambda x: x * float(k))


def hamming_distance(a, b) -> Column:
    """Places where the values differ."""
    a, b = vec(a), vec(b)
    return _same(a, b, F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)).cast("double"))


def jaccard_distance(a, b) -> Column:
    """1 less the share of places with the same non-zero value among those with any non-zero value."""
    a, b = vec(a), vec(b)
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda d: d))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda d: d))
    return _same(a, b, F.when(either > 0, 1 - both / either).otherwise(0.0))
