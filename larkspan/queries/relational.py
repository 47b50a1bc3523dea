"""Joins, set operations, sorting and common table expressions."""

from pyspark.sql import functions as F

from larkspan.functions import jsonb, strings
from larkspan.operators import dml
from larkspan.operators import relational as rel
from larkspan.registry import query
from larkspan.session import table


@query(
    "flagship_segment_revenue",
    """SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
              count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY revenue DESC NULLS LAST LIMIT 5""",
)
def flagship_segment_revenue(spark, sf_dir):
    """lineitem x orders x customer, revenue by segment, the five largest."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.count("*").alias("n_lines"),
            F.count_distinct("o_orderkey").alias("n_orders"),
        )
        .orderBy(F.desc_nulls_last("revenue"))
        .limit(5)
    )


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return o.filter("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf):
    s, n = _t(spark, sf, "supplier", "nation")
    return s.filter("s_acctbal > 5000").join(n, s.s_nationkey == n.n_nationkey, "right").select("s_suppkey", "n_name")


@query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
def join_full(spark, sf):
    s, c = _t(spark, sf, "supplier", "customer")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey") * 20, "full").select("c_custkey", "s_suppkey")


@query("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
def join_using(spark, sf):
    n, r = _t(spark, sf, "nation", "region")
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")).join(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), on=["k"])


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    n, r = _t(spark, sf, "nation", "region")
    return n.crossJoin(r).select("n_name", "r_name")


@query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@query("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi_exists(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti_not_exists(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("not_in_without_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_without_null(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return rel.not_in(c.select("c_custkey"), "c_custkey", o, "o_custkey")


@query("not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders)")
def not_in_with_null(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return rel.not_in(c.select("c_custkey"), "c_custkey", o.select(F.nullif("o_custkey", F.lit(4)).alias("k")), "k")


@query("compare_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 7)")
def compare_all(spark, sf):
    p = table(spark, sf, "part")
    return rel.compare_all(p, "p_retailprice", ">=", p.filter("p_size = 7").select(F.col("p_retailprice").alias("v")), "v").select("p_partkey")


@query("compare_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')")
def compare_any(spark, sf):
    s, c = _t(spark, sf, "supplier", "customer")
    return rel.compare_any(s, "s_acctbal", "<", c.filter("c_mktsegment = 'BUILDING'"), "c_acctbal").select("s_suppkey")


@query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(spark, sf):
    o = table(spark, sf, "orders")
    return o.join(F.broadcast(o.agg((F.avg("o_totalprice") * 1.9).alias("m"))), F.col("o_totalprice") > F.col("m")).select("o_orderkey")


@query("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@query("lateral_json_each", "SELECT event_id, e.key AS key, CAST(e.value AS VARCHAR) AS value FROM events, json_each(props) e")
def lateral_json_each(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.explode(jsonb.entries("props")).alias("e")).select("event_id", "e.key", "e.value")


@query("lateral_subquery", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) l")
def lateral_subquery(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    best = rel.top_k(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return c.join(best, c.c_custkey == best.o_custkey).select("c_custkey", "o_orderkey")


@query(
    "range_overlap_join",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch_us(o_orderdate) AS DOUBLE) / 86400000000 AS lo FROM orders)
       SELECT a.k AS k1, b.k AS k2 FROM r a JOIN r b ON a.c = b.c AND a.k < b.k AND a.lo < b.lo + 30 AND b.lo < a.lo + 30""",
)
def range_overlap_join(spark, sf):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000
    r = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("lo"), (day + 30).alias("hi"))
    a, b = r.toDF("k1", "c1", "lo1", "hi1"), r.toDF("k2", "c2", "lo2", "hi2")
    return rel.range_overlap_join(a, b, ("lo1", "lo2"), ("hi1", "hi2"), 30.0, on=[("c1", "c2")]).filter("k1 < k2").select("k1", "k2")


for _kind, _all in (("union", False), ("union", True), ("intersect", False), ("intersect", True), ("except", False), ("except", True)):

    @query(
        f"set_{_kind}{'_all' * _all}",
        f"SELECT c_nationkey AS k FROM customer {_kind.upper()} {'ALL ' * _all}SELECT s_nationkey FROM supplier",
    )
    def _set(spark, sf, kind=_kind, all_=_all):
        s, c = _t(spark, sf, "supplier", "customer")
        return rel.set_operation(kind, c.select(F.col("c_nationkey").alias("k")), s.select("s_nationkey"), all_)


@query("sort_nulls_limit_offset", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5")
def sort_nulls_limit_offset(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return o.orderBy(*rel.order("-p", "o_orderkey")).offset(5).limit(20)


@query("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k_global(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_first("o_totalprice"), "o_orderkey").limit(10)


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rel.distinct_on(o, ["o_custkey"], ["o_custkey", "-o_orderdate", "o_orderkey"])


@query("with_cte", "WITH a (k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY 1), b AS (SELECT avg(total) AS m FROM a) SELECT k, round(total, 2) AS total FROM a, b WHERE total > 2 * m")
def with_cte(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total"))
    return a.join(F.broadcast(a.agg(F.avg("total").alias("m"))), F.col("total") > 2 * F.col("m")).select("k", F.round("total", 2).alias("total"))


@query("recursive_sql", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_sql(spark, sf):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("recursive_graph", "WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT (k * 3 + 1) % 50 FROM t) SELECT k FROM t")
def recursive_graph(spark, sf):
    return rel.recursive(spark.sql("SELECT 0 AS k"), lambda d: d.select(((F.col("k") * 3 + 1) % 50).cast("int").alias("k")), distinct=True)


@query("generate_series", "SELECT generate_series FROM generate_series(10, -20, -7) UNION ALL SELECT generate_series FROM generate_series(1, 5) UNION ALL SELECT generate_series FROM generate_series(5, 1)")
def generate_series(spark, sf):
    return rel.generate_series(spark, 10, -20, -7).union(rel.generate_series(spark, 1, 5)).union(rel.generate_series(spark, 5, 1))


@query("series_per_row", "SELECT n_nationkey, unnest(generate_series(n_regionkey, 3)) AS i FROM nation")
def series_per_row(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(rel.series(F.col("n_regionkey").cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long"))).alias("i"))


@query("values_list", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(n, s)")
def values_list(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'c') t(n, s)")


@query("predicates", "SELECT o_orderkey FROM orders WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus = 'F')) OR o_totalprice BETWEEN 1000 AND 20000 OR o_orderstatus NOT IN ('F', 'O', 'P')")
def predicates(spark, sf):
    return table(spark, sf, "orders").filter((rel.in_list("o_orderpriority", ["1-URGENT", "2-HIGH"]) & ~(F.col("o_orderstatus") == "F")) | rel.between("o_totalprice", 1000, 20000) | rel.in_list("o_orderstatus", ["F", "O", "P"], negate=True)).select("o_orderkey")


@query("in_list_with_null", "SELECT n_nationkey, n_nationkey IN (1, 2, NULL) AS a, n_nationkey NOT IN (1, 2, NULL) AS b FROM nation")
def in_list_with_null(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", rel.in_list("n_nationkey", [1, 2, None]).alias("a"), rel.in_list("n_nationkey", [1, 2, None], negate=True).alias("b"))


@query("between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN least(20, 10) AND greatest(20, 10)")
def between_symmetric(spark, sf):
    return table(spark, sf, "part").filter(rel.between("p_size", 20, 10, symmetric=True)).select("p_partkey")


@query(
    "truth_tests",
    """WITH b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 2 = 0 END AS x FROM nation)
       SELECT k, x IS TRUE AS t, x IS NOT TRUE AS nt, x IS FALSE AS f, x IS UNKNOWN AS u, x IS DISTINCT FROM true AS d, CASE WHEN x THEN 'y' WHEN NOT x THEN 'n' ELSE '?' END AS c, coalesce(x, false) AS co FROM b""",
)
def truth_tests(spark, sf):
    k = F.col("n_nationkey")
    b = table(spark, sf, "nation").select(k.alias("k"), F.when(k % 3 != 0, k % 2 == 0).alias("x"))
    t = rel.truth
    return b.select("k", t("x", "TRUE").alias("t"), t("x", "NOT TRUE").alias("nt"), t("x", "FALSE").alias("f"), t("x", "UNKNOWN").alias("u"), rel.is_distinct_from("x", True).alias("d"), F.when(F.col("x"), "y").when(~F.col("x"), "n").otherwise("?").alias("c"), F.coalesce("x", F.lit(False)).alias("co"))


@query("like_family", r"SELECT p_partkey, p_type LIKE '%BRASS' AS a, p_type ILIKE 'small%' AS b, p_type NOT LIKE '%TIN%' AS c, regexp_matches(p_type, '^S.*L$') AS d, regexp_matches(p_type, 'steel', 'i') AS e, p_type SIMILAR TO '(SMALL|LARGE) .*' AS f FROM part")
def like_family(spark, sf):
    t = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", t.like("%BRASS").alias("a"), t.ilike("small%").alias("b"), (~t.like("%TIN%")).alias("c"), strings.regexp_like(t, "^S.*L$").alias("d"), strings.regexp_like(t, "steel", "i").alias("e"), strings.similar_to(t, "(SMALL|LARGE) %").alias("f"))


@query("bit_operators", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS b, xor(p_size, 5) AS c, ~p_size AS d, p_size << 2 AS e, p_size >> 1 AS f FROM part")
def bit_operators(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", s.bitwiseAND(6).alias("a"), s.bitwiseOR(8).alias("b"), s.bitwiseXOR(5).alias("c"), F.bitwise_not(s).alias("d"), F.shiftleft(s, 2).alias("e"), F.shiftright(s, 1).alias("f"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS p, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("p"), F.round(F.avg("l_discount"), 6).alias("d"), F.count("*").alias("n"))


# data changes, as the table after the statement

_NEW = "SELECT n_nationkey + 20 AS n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey FROM nation WHERE n_nationkey < 10"


@query("insert_select", f"SELECT * FROM nation UNION ALL {_NEW}")
def insert_select(spark, sf):
    n = table(spark, sf, "nation")
    return dml.insert(n, _incoming(n)).table


def _incoming(n):
    return n.filter("n_nationkey < 10").select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"), "n_regionkey")


@query(
    "upsert_update",
    f"""WITH e AS ({_NEW}) SELECT coalesce(t.n_nationkey, e.n_nationkey) AS n_nationkey,
        CASE WHEN t.n_nationkey IS NULL OR (e.n_nationkey IS NOT NULL AND t.n_regionkey <> 3) THEN e.n_name ELSE t.n_name END AS n_name,
        coalesce(t.n_regionkey, e.n_regionkey) AS n_regionkey FROM nation t FULL JOIN e ON t.n_nationkey = e.n_nationkey""",
)
def upsert_update(spark, sf):
    n = table(spark, sf, "nation")
    return dml.upsert(n, _incoming(n), ["n_nationkey"], {"n_name": F.col("excluded.n_name")}, F.col("t.n_regionkey") != 3).table


@query("upsert_nothing_returning", f"SELECT * FROM ({_NEW}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def upsert_nothing_returning(spark, sf):
    n = table(spark, sf, "nation")
    return dml.upsert(n, _incoming(n), ["n_nationkey"]).affected


@query("update_from", "SELECT c.c_custkey, CASE WHEN n.n_nationkey IS NULL THEN c.c_name ELSE n.n_name || c.c_name END AS c_name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON c_nationkey = n_nationkey")
def update_from(spark, sf):
    c, n = _t(spark, sf, "customer", "nation")
    return dml.update_from(c, n.filter("n_regionkey = 1"), F.col("t.c_nationkey") == F.col("o.n_nationkey"), {"c_name": F.concat(F.col("o.n_name"), F.col("t.c_name"))}, ["c_custkey"]).table.select("c_custkey", "c_name")


@query("update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_where(spark, sf):
    s = table(spark, sf, "supplier")
    return dml.update(s, {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0).table.select("s_suppkey", "s_acctbal")


@query("delete_unknown_stays", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def delete_unknown_stays(spark, sf):
    o = table(spark, sf, "orders")
    return dml.delete(o, F.nullif("o_orderstatus", F.lit("P")) == "F").table.select("o_orderkey")


@query("delete_using", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_using(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return dml.delete_using(o, c.filter("c_mktsegment = 'BUILDING'"), F.col("t.o_custkey") == F.col("o.c_custkey")).table.select("o_orderkey")
