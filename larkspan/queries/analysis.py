"""Aggregates and windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.functions import aggregates as agg
from larkspan.functions import jsonb, maths
from larkspan.operators import windows
from larkspan.registry import query
from larkspan.session import table


def _r(c, n=6):
    return F.round(c, n)


_STATS = ("var_pop", "var_samp", "stddev_pop", "stddev_samp")


@query("agg_statistics", "SELECT l_returnflag, " + ", ".join(f"round({f}(l_quantity), 6) AS {f}" for f in _STATS) + " FROM lineitem GROUP BY 1")
def agg_statistics(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[_r(getattr(F, f)("l_quantity")).alias(f) for f in _STATS])


_REGR = ("count", "sxx", "syy", "sxy", "avgx", "avgy", "slope", "intercept", "r2")


@query("agg_regression", "SELECT l_linestatus, " + ", ".join(f"{'regr_count' if f == 'count' else 'round(regr_' + f}(l_extendedprice / 1000, l_quantity){'' if f == 'count' else ', 4)'} AS {f}" for f in _REGR) + " FROM lineitem GROUP BY 1")
def agg_regression(spark, sf):
    y = F.col("l_extendedprice") / 1000
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(*[(agg.regr(f, y, "l_quantity") if f == "count" else _r(agg.regr(f, y, "l_quantity"), 4)).alias(f) for f in _REGR])


@query("agg_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs FROM lineitem")
def agg_correlation(spark, sf):
    return table(spark, sf, "lineitem").agg(_r(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), _r(F.covar_pop("l_quantity", "l_extendedprice"), 2).alias("cp"), _r(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cs"))


@query("agg_sample_of_one", "SELECT var_samp(p_size) AS v, stddev_samp(p_size) AS s FROM part WHERE p_partkey = 1")
def agg_sample_of_one(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey = 1")
    return p.agg(agg.sample_or_null(F.var_samp, "p_size").alias("v"), agg.sample_or_null(F.stddev_samp, "p_size").alias("s"))


@query("agg_boolean", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, bool_and(o_totalprice > 0) AS e FROM orders GROUP BY 1")
def agg_boolean(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(agg.bool_and(p > 1000).alias("a"), agg.bool_or(p > 400000).alias("o"), F.every(p > 0).alias("e"))


@query("agg_boolean_empty", "SELECT bool_and(o_totalprice > 0) AS a, bool_or(o_totalprice > 0) AS o, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
def agg_boolean_empty(spark, sf):
    p = F.col("o_totalprice") > 0
    return table(spark, sf, "orders").filter("o_orderkey < 0").agg(agg.bool_and(p).alias("a"), agg.bool_or(p).alias("o"), F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))


@query("agg_bits", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY 1")
def agg_bits(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(agg.bit_and("p_size").alias("a"), agg.bit_or("p_size").alias("o"), agg.bit_xor("p_size").alias("x"))


@query("agg_distinct_filter", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_totalprice > 100000) AS f, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS s, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
def agg_distinct_filter(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("d"), agg.filtered(F.count, "*", F.col("o_totalprice") > 100000).alias("f"), _r(agg.filtered(F.sum, "o_totalprice", F.col("o_orderpriority") == "1-URGENT"), 2).alias("s"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query("agg_array", "SELECT o_custkey, array_agg(nullif(o_orderstatus, 'P') ORDER BY o_orderkey) AS a, string_agg(o_orderstatus, '-' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1")
def agg_array(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(agg.array_agg(F.nullif("o_orderstatus", F.lit("P")), "o_orderkey").alias("a"), agg.string_agg("o_orderstatus", "-", "o_orderkey").alias("s"))


@query("agg_json", "SELECT o_custkey, CAST(to_json(array_agg(nullif(o_orderstatus, 'P') ORDER BY o_orderkey)) AS VARCHAR) AS j FROM orders GROUP BY 1")
def agg_json(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(jsonb.array_agg_json(F.nullif("o_orderstatus", F.lit("P")), "o_orderkey").alias("j"))


@query("agg_json_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY 1")
def agg_json_object(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(jsonb.object_agg("n_name", "n_nationkey", "n_name").alias("j"))


@query(
    "agg_hypothetical",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 25) + 1 AS r, count(DISTINCT l_quantity) FILTER (WHERE l_quantity < 25) + 1 AS d,
       round(count(*) FILTER (WHERE l_quantity < 25) / count(*), 9) AS p, round((count(*) FILTER (WHERE l_quantity <= 25) + 1) / (count(*) + 1), 9) AS c FROM lineitem GROUP BY 1""",
)
def agg_hypothetical(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(agg.hypothetical_rank(25, "l_quantity").alias("r"), agg.hypothetical_dense_rank(25, "l_quantity").alias("d"), _r(agg.hypothetical_percent_rank(25, "l_quantity"), 9).alias("p"), _r(agg.hypothetical_cume_dist(25, "l_quantity"), 9).alias("c"))


@query("agg_accum_state", "SELECT [CAST(count(l_quantity) AS DOUBLE), sum(l_quantity), sum(l_quantity * l_quantity)] AS s, [CAST(count(l_discount) AS DOUBLE), sum(l_quantity), sum(l_quantity * l_quantity), sum(l_tax * 0 + 1), sum(l_tax * 0 + 1), sum(l_quantity)] AS g FROM lineitem")
def agg_accum_state(spark, sf):
    return table(spark, sf, "lineitem").agg(maths.float8_accum("l_quantity").alias("s"), maths.float8_regr_accum(F.col("l_tax") * 0 + 1, "l_quantity").alias("g"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).filter("n > 12 AND m > 100000").select("o_custkey", "n")


@query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_grouping_sets(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query("agg_percentile", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q FROM lineitem GROUP BY 1")
def agg_percentile(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(agg.percentile_cont("l_quantity", 0.25).alias("q"))


@query("agg_any_value", "SELECT c_mktsegment, min(c_nationkey) AS v FROM customer GROUP BY 1")
def agg_any_value(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(agg.any_value("c_nationkey").alias("v"))


_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _w():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("window_ranking", f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(4) OVER w AS nt FROM orders WINDOW w AS ({_BY}), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranking(spark, sf):
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(_w()).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"), _r(F.percent_rank().over(p), 9).alias("pr"), _r(F.cume_dist().over(p), 9).alias("cd"), F.ntile(4).over(_w()).cast("long").alias("nt"))


@query("window_offset", f"SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, -1.0) OVER w AS b, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders WINDOW w AS ({_BY})")
def window_offset(spark, sf):
    w = _w()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("a"), F.lead("o_totalprice", 2, -1.0).over(w).alias("b"), F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("l"), F.nth_value("o_orderkey", 2).over(whole).alias("n"))


@query("window_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, round(avg(o_totalprice) OVER (w ROWS 3 PRECEDING), 4) AS a, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS ({_BY})")
def window_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _r(F.sum("o_totalprice").over(_w().rowsBetween(-2, 1)), 2).alias("s"), _r(F.avg("o_totalprice").over(_w().rowsBetween(-3, 0)), 4).alias("a"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))


@query("window_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM part")
def window_range(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(w.rangeBetween(-2, 2)).alias("n"), F.sum("p_size").over(w).alias("s"))


@query("window_groups", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def window_groups(spark, sf):
    return windows.groups_frame(table(spark, sf, "part"), F.count("*"), "n", ["p_brand"], ["p_size"], -1, 1).select("p_partkey", "n")


for _x in ("CURRENT ROW", "GROUP", "TIES"):

    @query(f"window_exclude_{_x.split()[0].lower()}", f"SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey // 500 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {_x}) AS BIGINT) AS s FROM part")
    def _exclude(spark, sf, x=_x):
        part = table(spark, sf, "part").withColumn("_h", F.floor(F.col("p_partkey") / 500))
        return windows.exclude_frame(part, "sum", F.col("p_partkey"), "s", ["p_brand"], ["p_size", "_h"], None, None, x).select("p_partkey", "s")


@query("window_top_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def window_top_per_group(spark, sf):
    from larkspan.operators.relational import top_k

    return top_k(table(spark, sf, "customer"), ["c_mktsegment"], ["-c_acctbal", "c_custkey"], 3).select("c_mktsegment", "c_custkey")
