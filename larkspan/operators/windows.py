"""Window frames that Spark lacks: GROUPS frames and EXCLUDE clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.relational import order

UNBOUNDED = None


def groups_frame(df: DataFrame, aggregate, out: str, partition: list, by: list, start: int | None, end: int | None) -> DataFrame:
    """aggregate OVER (PARTITION BY ... ORDER BY by GROUPS BETWEEN start AND end): peer groups numbered, then a RANGE over the numbers."""
    w = Window.partitionBy(*partition)
    ranked = df.withColumn("_peer", F.dense_rank().over(w.orderBy(*order(*by))))
    lo = Window.unboundedPreceding if start is UNBOUNDED else start
    hi = Window.unboundedFollowing if end is UNBOUNDED else end
    return ranked.withColumn(out, aggregate.over(w.orderBy("_peer").rangeBetween(lo, hi))).drop("_peer")


def exclude_frame(df: DataFrame, kind: str, value: Column, out: str, partition: list, by: list, start: int | None, end: int | None, exclude: str, frame: str = "rows") -> DataFrame:
    """sum, count, avg, min, max or array_agg of `value` over a ROWS or GROUPS frame with an EXCLUDE clause.

    A RANGE frame without offsets is the GROUPS frame of the same bounds. What
    stands before and after the excluded rows is aggregated apart and put
    together; nothing is subtracted, so large values swallow no small ones and
    min and max work. Peers stand together: on an unbounded side that part is a
    plain frame, on a bounded side of a ROWS frame the few rows are filtered.
    NULLs count as in the plain aggregates; array_agg keeps them.
    """
    exclude, lo_end, hi_end = exclude.upper(), Window.unboundedPreceding, Window.unboundedFollowing
    lo, hi = lo_end if start is UNBOUNDED else start, hi_end if end is UNBOUNDED else end
    w = Window.partitionBy(*partition).orderBy(*order(*by))
    numbered = df.withColumn("_v", value).withColumn("_rn", F.row_number().over(w)).withColumn("_peer", F.dense_rank().over(w))
    kind_of_sum = numbered.select(F.sum("_v") if kind in ("sum", "avg") else F.count("_v")).schema[0].dataType
    rows, groups = Window.partitionBy(*partition).orderBy("_rn"), Window.partitionBy(*partition).orderBy("_peer")
    peers = Window.partitionBy(*partition, "_peer")
    v, rn = F.col("_v"), F.col("_rn")

    def over(window) -> Column:
        """The part of the aggregate over a plain frame."""
        if kind == "array_agg":
            return F.transform(F.collect_list(F.struct(v)).over(window), lambda x: x["_v"])
        if kind == "avg":
            return F.struct(F.sum(v).over(window).alias("s"), F.count(v).over(window).alias("n"))
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](v).over(window)

    def filtered(window, test) -> Column:
        """The same over the rows of a narrow frame that pass test(peer number)."""
        mine = F.col("_peer")
        kept = F.transform(F.filter(F.collect_list(F.struct("_peer", v)).over(window), lambda x: test(x["_peer"], mine)), lambda x: x["_v"])
        some = F.filter(kept, lambda x: x.isNotNull())
        total = lambda: F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast(kind_of_sum), lambda a, x: (a + x).cast(kind_of_sum)))
        if kind == "avg":
            return F.struct(total().alias("s"), F.size(some).cast("long").alias("n"))
        return {"array_agg": lambda: kept, "sum": total, "count": lambda: F.size(some).cast("long"), "min": lambda: F.array_min(some), "max": lambda: F.array_max(some)}[kind]()

    def outside_rows() -> list[Column]:
        """Parts of a ROWS frame before and after the current row's peers."""
        parts = []
        if start is UNBOUNDED:
            before = over(groups.rangeBetween(lo_end, -1))
            parts.append(before if end is UNBOUNDED or end >= -1 else F.when(F.min(rn).over(peers) > rn + end, over(rows.rowsBetween(lo_end, end))).otherwise(before))
        elif start < 0:
            parts.append(filtered(rows.rowsBetween(lo, min(hi, -1)), lambda a, b: a < b))
        if end is UNBOUNDED:
            after = over(groups.rangeBetween(1, hi_end))
            parts.append(after if start is UNBOUNDED or start <= 1 else F.when(F.max(rn).over(peers) < rn + start, over(rows.rowsBetween(start, hi_end))).otherwise(after))
        elif end > 0:
            parts.append(filtered(rows.rowsBetween(max(lo, 1), hi), lambda a, b: a > b))
        return parts

    def halves(window) -> list[Column]:
        """Parts of a frame of `window` on both sides of its current value."""
        side = window.rowsBetween if window is rows else window.rangeBetween
        return [over(side(lo, min(hi, -1)))] * (lo < 0) + [over(side(max(lo, 1), hi))] * (hi > 0)

    own_in = lo <= 0 <= hi
    own = [over(rows.rowsBetween(0, 0))] * own_in
    if frame == "rows":
        parts = {"CURRENT ROW": lambda: halves(rows), "GROUP": outside_rows, "TIES": lambda: outside_rows()[:1] + own + outside_rows()[1:], "NO OTHERS": lambda: [over(rows.rowsBetween(lo, hi))]}[exclude]()
    else:
        mates = [over(peers.orderBy("_rn").rowsBetween(lo_end, -1)), over(peers.orderBy("_rn").rowsBetween(1, hi_end))] * own_in
        parts = {"CURRENT ROW": lambda: halves(groups) + mates, "GROUP": lambda: halves(groups), "TIES": lambda: halves(groups) + own, "NO OTHERS": lambda: [over(groups.rangeBetween(lo, hi))]}[exclude]()
    return numbered.withColumn(out, _together(kind, parts, kind_of_sum)).drop("_v", "_rn", "_peer")


def _together(kind: str, parts: list[Column], kind_of_sum) -> Column:
    """One aggregate of its parts over rows that are apart; NULL (count: 0) where no part has a value."""
    nothing = F.lit(None).cast(kind_of_sum)

    def total(values) -> Column:
        add = lambda a, b: F.coalesce((a + b).cast(kind_of_sum), a, b)
        return reduce(add, values, nothing)

    if kind in ("sum", "count"):
        out = total(parts)
        return out if kind == "sum" else F.coalesce(out, F.lit(0)).cast("long")
    if kind == "avg":
        return total([p["s"] for p in parts]) / F.nullif(reduce(lambda a, b: a + b, [p["n"] for p in parts], F.lit(0)), F.lit(0))
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None)
    whole = F.concat(*parts) if parts else F.lit(None)
    return F.when(F.size(whole) > 0, whole) if parts else whole
