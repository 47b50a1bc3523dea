"""Relational operators that Spark has no direct form of, composed of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.strings import col


def order(*items) -> list[Column]:
    """ORDER BY items with PostgreSQL's null order: a name, '-name' for descending, or a finished Column."""
    out = []
    for i in items:
        if isinstance(i, Column):
            out.append(i)
        elif i.startswith("-"):
            out.append(F.desc_nulls_first(i[1:]))
        else:
            out.append(F.asc_nulls_last(i))
    return out


def distinct_on(df: DataFrame, keys: list, by: list) -> DataFrame:
    """DISTINCT ON (keys) ... ORDER BY by: the first row of each key; Spark keeps one row a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order(*by))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list, by: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order(*by))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """column NOT IN (SELECT other_column): no rows if the list has a NULL, rows with NULL only if it is empty."""
    values = other.select(F.col(other_column).alias("_v"))
    facts = values.agg(F.count("*").alias("_n"), F.count_if(F.col("_v").isNull()).alias("_nulls"))
    # one row of two counts, so its broadcast is bounded
    return (
        df.join(values.filter("_v IS NOT NULL").distinct(), F.col(column) == F.col("_v"), "left_anti")
        .join(F.broadcast(facts), (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull()), "left_semi")
    )


def compare_all(df: DataFrame, column: str, op: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows with column op ALL (SELECT other_column), by extremes and counts; true for an empty list."""
    v = F.col(other_column)
    facts = other.agg(F.count("*").alias("_n"), F.count(v).alias("_k"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    c, whole = F.col(column), F.col("_n") == F.col("_k")
    test = {
        "<": c < F.col("_lo"), "<=": c <= F.col("_lo"), ">": c > F.col("_hi"), ">=": c >= F.col("_hi"),
        "=": (c == F.col("_lo")) & (c == F.col("_hi")),
    }
    if op == "<>":
        return not_in(df, column, other, other_column)
    return df.join(F.broadcast(facts), (F.col("_n") == 0) | (whole & test[op]), "left_semi")


def compare_any(df: DataFrame, column: str, op: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows with column op ANY (SELECT other_column); = is a semi join."""
    v, c = F.col(other_column), F.col(column)
    if op == "=":
        return df.join(other.select(v.alias("_v")), c == F.col("_v"), "left_semi")
    facts = other.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    test = {"<": c < F.col("_hi"), "<=": c <= F.col("_hi"), ">": c > F.col("_lo"), ">=": c >= F.col("_lo"), "<>": (c != F.col("_lo")) | (c != F.col("_hi"))}[op]
    return df.join(F.broadcast(facts), test, "left_semi")


def range_overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], width: float, on: list | None = None) -> DataFrame:
    """Pairs with left.[lo, hi) && right.[lo, hi), by an equi-join over bins of `width`.

    Each side is listed under every bin that it touches; a pair is taken in the
    bin in which the later one begins, so no pair comes twice and nothing is
    compared outside its bins. Bounds are numbers.
    """
    def binned(df, a, b, name):
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor((F.col(b) - 1e-9) / width).cast("long"))))

    l, r = binned(left.filter(F.col(lo[0]) < F.col(hi[0])), lo[0], hi[0], "_lbin"), binned(right.filter(F.col(lo[1]) < F.col(hi[1])), lo[1], hi[1], "_rbin")
    cond = (F.col("_lbin") == F.col("_rbin")) & (F.col(lo[0]) < F.col(hi[1])) & (F.col(lo[1]) < F.col(hi[0])) & (F.floor(F.greatest(F.col(lo[0]), F.col(lo[1])) / width) == F.col("_lbin"))
    for a, b in on or []:
        cond = cond & (F.col(a) == F.col(b))
    return l.join(r, cond).drop("_lbin", "_rbin")


def knn(queries: DataFrame, items: DataFrame, distance: Column, keys: list, k: int, tie: list, most_queries: int = 10_000) -> DataFrame:
    """The k nearest items of each query: ORDER BY distance LIMIT k for each.

    The queries are a bounded set (checked) that is broadcast; items are read
    once, and each task keeps k rows a query before anything is shuffled.
    """
    n = queries.limit(most_queries + 1).count()
    if n > most_queries:
        raise ValueError(f"more than {most_queries} queries; search them in blocks")
    pairs = items.join(F.broadcast(queries)).withColumn("distance", distance)
    return top_k(pairs, keys, [F.asc_nulls_last("distance"), *[F.asc(t) for t in tie]], k)


def generate_series(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    """generate_series(start, stop, step): inclusive, empty if the step leads away, any size."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("generate_series"))


def series(start, stop, step=1) -> Column:
    """generate_series() of row values as an array to explode; empty if the step leads away."""
    c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    a, b, s = c(start), c(stop), c(step)
    bad = ((s > 0) & (a > b)) | ((s < 0) & (a < b))
    return F.when(bad, F.slice(F.array(a), 1, 0)).otherwise(F.sequence(a, F.when(bad, a).otherwise(b), s))


def recursive(seed: DataFrame, step, distinct: bool = False, most_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE as a fixpoint: step(rows of the last round) gives the next round until it is empty.

    With `distinct` (UNION) rows seen before are dropped, so cycles end. Each
    round is checkpointed to the shared folder of the cluster.
    """
    sc = seed.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkspan-"))
    total = now = (seed.distinct() if distinct else seed).checkpoint()
    for _ in range(most_rounds):
        new = step(now).toDF(*seed.columns)
        now = (new.subtract(total) if distinct else new).checkpoint()
        if now.isEmpty():
            return total
        total = total.unionByName(now)
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def set_operation(kind: str, a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    """UNION, INTERSECT and EXCEPT, each with ALL; columns by position, names of the first."""
    b = b.toDF(*a.columns)
    if kind == "union":
        return a.union(b) if all_ else a.union(b).distinct()
    if kind == "intersect":
        return a.intersectAll(b) if all_ else a.intersect(b)
    if kind == "except":
        return a.exceptAll(b) if all_ else a.subtract(b)
    raise ValueError(kind)


def in_list(x, values: list, negate: bool = False) -> Column:
    """x [NOT] IN (list) with NULLs in the list."""
    c = col(x)
    known = [v for v in values if v is not None]
    out = c.isin(*known) if known else F.lit(False)
    if len(known) < len(values):
        out = F.when(out, F.lit(True))
    return ~out if negate else out


def between(x, a, b, symmetric: bool = False, negate: bool = False) -> Column:
    """x [NOT] BETWEEN [SYMMETRIC] a AND b."""
    c, a, b = col(x), *(v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    out = c.between(F.least(a, b), F.greatest(a, b)) if symmetric else c.between(a, b)
    return ~out if negate else out


def is_distinct_from(a, b) -> Column:
    return ~col(a).eqNullSafe(b if isinstance(b, Column) else F.lit(b))


def truth(x, kind: str) -> Column:
    """x IS [NOT] TRUE / FALSE / UNKNOWN."""
    c, no = col(x), kind.upper().startswith("NOT ")
    word = kind.upper().removeprefix("NOT ")
    out = c.isNull() if word == "UNKNOWN" else c.eqNullSafe(F.lit(word == "TRUE"))
    return ~out if no else out
