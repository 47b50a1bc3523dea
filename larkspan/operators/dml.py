"""INSERT, UPDATE, DELETE and upsert as DataFrame transformations: each gives the new table and the affected rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Change(NamedTuple):
    """The table after the statement, and what RETURNING sees."""

    table: DataFrame
    affected: DataFrame


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None, defaults: dict | None = None) -> Change:
    """INSERT INTO table (columns) rows; other columns get their default or NULL."""
    columns = columns or table.columns[: len(rows.columns)]
    if len(columns) != len(rows.columns):
        raise ValueError("INSERT has more expressions than target columns" if len(rows.columns) > len(columns) else "INSERT has more target columns than expressions")
    given, kinds = rows.toDF(*columns), dict(table.dtypes)
    full = given.select(*[(F.col(c) if c in columns else F.lit((defaults or {}).get(c))).cast(kinds[c]).alias(c) for c in table.columns])
    return Change(table.unionByName(full), full)


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One incoming row a key, the first in column order."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in rows.columns])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], assign: dict[str, Column] | None = None, where: Column | None = None) -> Change:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET assign WHERE where, or DO NOTHING without `assign`.

    In `assign` and `where`, `t.c` is the stored row and `excluded.c` the new
    one. A row with a NULL key conflicts with none. One full outer join on the
    keys; the incoming rows must not repeat a key.
    """
    t, e = table.alias("t"), _once(rows.toDF(*table.columns), keys).alias("excluded")
    on = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]
    both = t.withColumn("_old", F.lit(True)).alias("t").join(e.withColumn("_new", F.lit(True)).alias("excluded"), on, "full")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    hit = old & new & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) if assign else F.lit(False)
    out = [F.when(hit, (assign or {}).get(c, F.col(f"t.{c}"))).when(old, F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) for c in table.columns]
    merged = both.select(*out, (hit | ~old).alias("_changed"))
    return Change(merged.drop("_changed"), merged.filter("_changed").drop("_changed"))


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> Change:
    """UPDATE table SET assign WHERE where."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    kinds = dict(table.dtypes)
    new = lambda c: assign[c].cast(kinds[c]) if c in assign else F.col(c)
    return Change(table.select(*[F.when(hit, new(c)).otherwise(F.col(c)).alias(c) for c in table.columns]), table.filter(hit).select(*[new(c).alias(c) for c in table.columns]))


def update_from(table: DataFrame, other: DataFrame, on: Column, assign: dict[str, Column], keys: list[str]) -> Change:
    """UPDATE t SET assign FROM other o WHERE on; of several matching rows one counts, the first by o's columns."""
    t, o = table.alias("t"), other.alias("o")
    joined = t.join(o, on, "inner").select(*[F.col(f"t.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.struct(*[F.col(f"o.{c}") for c in other.columns]).alias("_o")], *[v.alias(f"_a{i}") for i, v in enumerate(assign.values())])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_o")
    new = joined.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_o").withColumn("_hit", F.lit(True))
    merged = table.join(new, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    kinds, at = dict(table.dtypes), {c: i for i, c in enumerate(assign)}
    out = merged.select(*[(F.when(F.col("_hit"), F.col(f"_a{at[c]}").cast(kinds[c])).otherwise(F.col(c)) if c in at else F.col(c)).alias(c) for c in table.columns], F.col("_hit"))
    return Change(out.drop("_hit"), out.filter("_hit").drop("_hit"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    """DELETE FROM table WHERE where; rows for which it is unknown stay."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Change(table.filter(~hit), table.filter(hit))


def delete_using(table: DataFrame, other: DataFrame, on: Column) -> Change:
    """DELETE FROM t USING o WHERE on."""
    t, o = table.alias("t"), other.alias("o")
    return Change(t.join(o, on, "left_anti"), t.join(o, on, "left_semi"))
