"""Aggregates with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def array_agg(x, *order, where: Column | None = None, distinct: bool = False) -> Column:
    """array_agg(x ORDER BY order): NULLs stay; NULL over no rows.

    Order items are columns or (column, descending) of sortable types; without
    any the order is not defined. NULLs of an ascending key go last.
    """
    x = col(x)
    if distinct:
        out = F.array_sort(F.collect_set(F.struct(x.isNull().alias("n"), x.alias("v"))))
    else:
        keys = []
        for i, o in enumerate(order):
            c, down = o if isinstance(o, tuple) else (o, False)
            c = col(c)
            if down:
                raise ValueError("descending keys are given as negated numbers")
            keys += [c.isNull().alias(f"n{i}"), c.alias(f"k{i}")]
        item = F.struct(*keys, x.alias("v"))
        item = item if where is None else F.when(where, item)
        out = F.collect_list(item)
        out = F.sort_array(out) if keys else out
    values = F.transform(out, lambda s: s["v"])
    return F.when(F.size(values) > 0, values)


def string_agg(x, delimiter: str, *order, where: Column | None = None) -> Column:
    """string_agg(x, delimiter ORDER BY order): NULLs are skipped; NULL over none."""
    kept = col(x).isNotNull() if where is None else where & col(x).isNotNull()
    return F.array_join(array_agg(x, *(order or (x,)), where=kept), delimiter)


def filtered(aggregate, x, where: Column) -> Column:
    """aggregate(x) FILTER (WHERE where); x = '*' counts rows."""
    return aggregate(F.when(where, F.lit(1) if x == "*" else col(x)))


def bool_and(x, empty: bool | None = None) -> Column:
    """bool_and() / every(); `empty` instead of NULL where there is no value."""
    out = F.bool_and(col(x))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def bool_or(x, empty: bool | None = None) -> Column:
    out = F.bool_or(col(x))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def bit_and(x) -> Column:
    return F.bit_and(col(x))


def bit_or(x) -> Column:
    return F.bit_or(col(x))


def bit_xor(x) -> Column:
    return F.bit_xor(col(x))


def hypothetical_rank(value, x, descending: bool = False) -> Column:
    """rank(value) WITHIN GROUP (ORDER BY x)."""
    v, x = F.lit(value), col(x)
    return F.count(F.when(x > v if descending else x < v, 1)) + 1


def hypothetical_dense_rank(value, x, descending: bool = False) -> Column:
    v, x = F.lit(value), col(x)
    return F.count_distinct(F.when(x > v if descending else x < v, x)) + 1


def hypothetical_percent_rank(value, x, descending: bool = False) -> Column:
    v, x = F.lit(value), col(x)
    n = F.count(F.lit(1))
    return F.when(n == 0, 0.0).otherwise(F.count(F.when(x > v if descending else x < v, 1)) / n)


def hypothetical_cume_dist(value, x, descending: bool = False) -> Column:
    v, x = F.lit(value), col(x)
    return (F.count(F.when(x >= v if descending else x <= v, 1)) + 1) / (F.count(F.lit(1)) + 1)


def regr(name: str, y, x) -> Column:
    """regr_count, _sxx, _syy, _sxy, _avgx, _avgy, _slope, _intercept, _r2 of (Y, X); pairs with a NULL are skipped."""
    return getattr(F, f"regr_{name}")(col(y), col(x))


def sample_or_null(aggregate, x) -> Column:
    """var_samp, stddev_samp, covar_samp: NULL for fewer than two values."""
    return F.when(F.count(col(x)) > 1, aggregate(col(x)))


def percentile_cont(x, fraction: float) -> Column:
    return F.percentile(col(x), fraction)


def any_value(x) -> Column:
    """any_value(), made reproducible."""
    return F.min(col(x))
