"""Query texts in the PostgreSQL dialect through the session engine, and governance over the sample tables."""

from pyspark.sql import functions as F

from larkspan.plans.engine import Engine
from larkspan.registry import query
from larkspan.session import table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def _engine(spark, sf):
    e = Engine(spark)
    for n in _TABLES:
        e.add_table(n, table(spark, sf, n))
    return e


#: Texts that both dialects read alike.
_SAME = {
    "sql_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "sql_casts": "SELECT n_nationkey::text AS a, (n_nationkey * 1.5)::int8 AS b, '7'::int4 + n_nationkey AS c, n_name::varchar AS d, CAST(n_nationkey AS float8) AS e FROM nation",
    "sql_json_operators": "SELECT event_id, props ->> 'k' AS a, (props ->> 'k')::int + 1 AS b FROM events",
    "sql_regex_operators": "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '.*(TIN|BRASS)' OR p_name ILIKE '%a%'",
    "sql_strings": "SELECT page_id, left(url, -5) AS a, right(url, 4) AS b, split_part(url, '/', 3) AS c, regexp_replace(url, 'e', 'E') AS d, regexp_replace(url, '[aeiou]', '', 'g') AS e, concat(url, NULL, '#') AS f, strpos(url, 'x') > 0 AS g FROM pages",
    "sql_filter_distinct": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS a, count(DISTINCT o_custkey) AS b, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS c FROM orders GROUP BY o_orderstatus",
    "sql_window": "SELECT o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS prev, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)",
    "sql_null_order": "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 7",
    "sql_subqueries": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "sql_cte_union": "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0), b(k) AS (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) SELECT k, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY k",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n * 2 FROM t WHERE n < 500) SELECT n FROM t",
    "sql_generate_series": "SELECT g.n AS n, r.r_name AS r_name FROM generate_series(1, 9, 4) AS g(n), region r",
    "sql_values_join": "SELECT n.n_name AS n_name, v.tag AS tag FROM nation n JOIN (VALUES (1, 'one'), (3, 'three')) AS v(k, tag) ON n.n_regionkey = v.k",
    "sql_full_join": "SELECT s_suppkey, p_partkey FROM supplier FULL OUTER JOIN part ON s_suppkey * 25 = p_partkey",
    "sql_arrays": "SELECT p_partkey, (ARRAY[p_size, 2, 3])[1] AS a, ARRAY[p_size, 2] @> ARRAY[2] AS b, p_size = ANY(ARRAY[1, 2, 3]) AS c FROM part",
    "sql_dates": "SELECT o_orderkey, date_trunc('month', o_orderdate)::date AS m, extract(dow FROM o_orderdate)::int AS d, extract(year FROM o_orderdate)::int AS y, o_orderdate + interval '1 month 2 days' AS p FROM orders",
    "sql_case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_acctbal, 10) AS g FROM customer",
    "sql_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(corr(l_quantity, l_tax), 6) AS r, round(regr_slope(l_tax, l_quantity), 8) AS b, bool_and(l_quantity > 0) AS t FROM lineitem GROUP BY l_returnflag",
}


def _register(name, text, oracle=None):
    @query(name, oracle or text)
    def run(spark, sf):
        return _engine(spark, sf).sql(text)


for _name, _text in _SAME.items():
    _register(_name, _text)

_register("sql_hypothetical", "SELECT l_returnflag, rank(25) WITHIN GROUP (ORDER BY l_quantity) AS r, dense_rank(25) WITHIN GROUP (ORDER BY l_quantity) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 25) + 1 AS r, count(DISTINCT l_quantity) FILTER (WHERE l_quantity < 25) + 1 AS d FROM lineitem GROUP BY l_returnflag")
_register("sql_regex_tilde", "SELECT p_partkey FROM part WHERE p_type ~ '^S.*L$' AND p_type !~* 'brass'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^S.*L$') AND NOT regexp_matches(p_type, 'brass', 'i')")
_register("sql_json_contains", """SELECT event_id, props @> '{"k": 69}' AS a, props ? 'k' AS b FROM events""", "SELECT event_id, json_extract_string(props, '$.k') = '69' AS a, true AS b FROM events")
_register("sql_lateral_json", "SELECT e.event_id AS event_id, j.key AS key, j.value AS value FROM events e, LATERAL jsonb_each_text(e.props) j", "SELECT event_id, j.key AS key, json_extract_string(props, '$.' || j.key) AS value FROM events, json_each(props) j")
_register("sql_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 30 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30")
_register("sql_quoted_names", 'SELECT n_name AS "Nation Name", n_regionkey AS plain FROM "nation"', 'SELECT n_name AS "Nation Name", n_regionkey AS plain FROM nation')


@query("sql_function_inline", "SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders WHERE o_totalprice > 300000")
def sql_function_inline(spark, sf):
    e = _engine(spark, sf)
    e.sql("CREATE FUNCTION gross(net double precision, rate double precision DEFAULT 0.19) RETURNS double precision LANGUAGE sql AS $$ SELECT round($1 * (1 + rate), 4) $$")
    return e.sql("SELECT o_orderkey, gross(o_totalprice) AS gross FROM orders WHERE o_totalprice > 300000")


@query("sql_plpgsql_expression", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 15 THEN 'M' ELSE 'S' END AS band FROM part")
def sql_plpgsql_expression(spark, sf):
    e = _engine(spark, sf)
    e.sql("CREATE FUNCTION band(n int) RETURNS text LANGUAGE plpgsql AS $$ DECLARE r text := 'S'; BEGIN IF n > 40 THEN RETURN 'L'; ELSIF n > 15 THEN r := 'M'; END IF; RETURN r; END $$")
    return e.sql("SELECT p_partkey, band(p_size) AS band FROM part")


@query("rls_policies", "SELECT c_custkey, c_nationkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND c_nationkey < 20")
def rls_policies(spark, sf):
    e = _engine(spark, sf)
    e.script("""CREATE ROLE analyst LOGIN; GRANT SELECT ON customer TO analyst; ALTER TABLE customer ENABLE ROW LEVEL SECURITY;
        CREATE POLICY a ON customer USING (c_mktsegment = 'BUILDING'); CREATE POLICY b ON customer FOR SELECT USING (c_acctbal < 0);
        CREATE POLICY c ON customer AS RESTRICTIVE USING (c_nationkey < 20); SET ROLE analyst""")
    return e.sql("SELECT c_custkey, c_nationkey FROM customer")


@query("sql_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'x' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'x100', 0")
def sql_upsert(spark, sf):
    e = _engine(spark, sf)
    e.script("CREATE UNIQUE INDEX k ON nation (n_nationkey); INSERT INTO nation SELECT n, 'x' || n, 0 FROM (VALUES (0), (1), (2), (100)) v(n) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@query("sql_update_delete_txn", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def sql_update_delete_txn(spark, sf):
    e = _engine(spark, sf)
    e.script("BEGIN; UPDATE supplier SET s_acctbal = 0 WHERE s_acctbal < 0; DELETE FROM supplier WHERE s_nationkey = 3; SAVEPOINT a; DELETE FROM supplier; ROLLBACK TO a; COMMIT")
    return e.sql("SELECT s_suppkey, s_acctbal FROM supplier")


@query("catalog_columns", "SELECT 'nation' AS table_name, * FROM (VALUES ('n_nationkey', 1, 'integer'), ('n_name', 2, 'text'), ('n_regionkey', 3, 'integer')) v(column_name, ordinal_position, data_type)")
def catalog_columns(spark, sf):
    return _engine(spark, sf).sql("SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'nation'")


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bin, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    from larkspan.streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))


@query(
    "events_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def events_sessions(spark, sf):
    from larkspan.streaming.windows import sessions

    return sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], F.count("*").alias("n")).select("user_id", "start", "n")
