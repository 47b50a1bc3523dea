"""Functions and statements that the other query modules leave out, each worked out anew in its SQL twin."""

from pyspark.sql import functions as F

from larkspan.functions import arrays, datetimes, fulltext, geometry, intervals, jsonb, maths, ranges, vectors
from larkspan.functions import strings as s
from larkspan.operators import windows
from larkspan.queries.front import _engine
from larkspan.registry import query
from larkspan.session import table


def _statements(name, script, text, oracle):
    """A query after a script of statements in the PostgreSQL dialect."""

    @query(name, oracle)
    def run(spark, sf):
        e = _engine(spark, sf)
        if script:
            e.script(script)
        return e.sql(text)


@query("str_like_escape", "SELECT page_id, url LIKE '%utm#_source%' ESCAPE '#' AS a, url LIKE '%#%%' ESCAPE '#' AS b FROM pages")
def str_like_escape(spark, sf):
    like = lambda p: F.col("url").like(s.like_escape(p, "#"))
    return table(spark, sf, "pages").select("page_id", like("%utm#_source%").alias("a"), like("%#%%").alias("b"))


@query("regex_match_groups", "SELECT page_id, CASE WHEN regexp_matches(url, '([a-z]+)=(.*)') THEN [regexp_extract(url, '([a-z]+)=(.*)', 1), regexp_extract(url, '([a-z]+)=(.*)', 2)] END AS a, unnest(regexp_split_to_array(url, '[/.?]+')) AS b FROM pages")
def regex_match_groups(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.regexp_match("url", "([a-z]+)=(.*)").alias("a"), F.explode(s.regexp_split_to_array("url", "[/.?]+")).alias("b"))


@query("regex_instr_class", "SELECT page_id, len(split_part(url, '.', 1)) + 1 AS a, CASE WHEN regexp_matches(url, '[0-9]') THEN len(regexp_extract(url, '^[^0-9]*')) + 1 ELSE 0 END AS b FROM pages")
def regex_instr_class(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.regexp_instr("url", "[.]").cast("long").alias("a"), s.regexp_instr("url", "[0-9]").cast("long").alias("b"))


@query("num_to_char", "SELECT c_custkey AS k, lpad(format('{:,.2f}', c_acctbal), 15, ' ') AS a, format('{:.2f}', c_acctbal) AS b, lpad(CAST(c_custkey AS VARCHAR), 8, ' ') AS c FROM customer")
def num_to_char(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), s.to_char_number("c_acctbal", "999,999,990.00").alias("a"), s.to_char_number("c_acctbal", "FM999999990.00").alias("b"), s.to_char_number("c_custkey", "9999999").alias("c"))


@query("text_to_number", "SELECT c_custkey AS k, c_acctbal AS a, -abs(c_acctbal) AS b, -abs(c_acctbal) AS c FROM customer")
def text_to_number(spark, sf):
    shown = F.format_number(F.abs("c_acctbal").cast("decimal(12,2)"), 2)
    signed = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), shown)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), s.to_number(signed, "999,999.99").alias("a"), s.to_number(F.concat(shown, F.lit("-"))).alias("b"), s.to_number(F.concat(F.lit("<"), shown, F.lit(">"))).alias("c"))


@query("uuid_fields", "SELECT event_id AS k, 7 AS v, date_trunc('millisecond', ts) AS t FROM events")
def uuid_fields(spark, sf):
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0")
    u = F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7abc-8def-"), F.lpad(F.lower(F.hex("event_id")), 12, "0"))
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), s.uuid_version(u).alias("v"), s.uuid_timestamp(u).cast("timestamp_ntz").alias("t"))


@query("math_more", "SELECT c_custkey AS k, round(ln(c_custkey + 1) / ln(2), 8) AS a, round(sin(c_custkey), 8) AS b, round(cos(c_custkey), 8) AS c, trunc(c_acctbal / 100) * 100 AS d, trunc(c_acctbal * 10) / 10 AS e FROM customer")
def math_more(spark, sf):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(k.alias("k"), F.round(maths.log(k + 1, 2), 8).alias("a"), F.round(F.sin(k), 8).alias("b"), F.round(F.cos(k), 8).alias("c"), maths.trunc(x, -2).alias("d"), maths.trunc(x, 1).alias("e"))


@query("math_special", "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN true ELSE false END AS nan_, c_custkey % 5 > 2 AS fin, CASE WHEN c_custkey % 5 > 2 THEN CAST(c_custkey AS DOUBLE) END AS x, rtrim(rtrim(format('{:.4f}', c_acctbal), '0'), '.') AS t FROM customer")
def math_special(spark, sf):
    k = F.col("c_custkey")
    x = maths.parse_float(F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "-infinity").when(k % 5 == 2, "Infinity").otherwise(k.cast("string")))
    return table(spark, sf, "customer").select(k.alias("k"), F.isnan(x).alias("nan_"), maths.is_finite(x).alias("fin"), F.when(maths.is_finite(x), x).alias("x"), maths.trim_scale(s.fixed("c_acctbal", 4)).alias("t"))


@query("date_trunc_long", "SELECT o_orderkey AS k, make_timestamp(y - y % 10, 1, 1, 0, 0, 0.0) AS a, make_timestamp((y - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0.0) AS b, make_timestamp((y - 1) // 1000 * 1000 + 1, 1, 1, 0, 0, 0.0) AS c FROM (SELECT o_orderkey, year(o_orderdate) + o_orderkey % 40 AS y FROM orders)")
def date_trunc_long(spark, sf):
    d = F.make_timestamp_ntz(F.year("o_orderdate") + (F.col("o_orderkey") % 40).cast("int"), F.month("o_orderdate"), F.lit(1), F.lit(1), F.lit(2), F.lit(3))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), *[datetimes.date_trunc(f, d).alias(a) for f, a in (("decade", "a"), ("century", "b"), ("millennium", "c"))])


@query("date_zones", "SELECT event_id AS k, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS a, ts + INTERVAL 9 HOUR AS b, ts - INTERVAL '3 hours 30 minutes' AS c FROM events")
def date_zones(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), datetimes.date_trunc_tz("day", "ts", "Asia/Tokyo").cast("timestamp_ntz").alias("a"), datetimes.at_time_zone("ts", "Asia/Tokyo").alias("b"), datetimes.at_time_zone("ts", "-03:30").alias("c"))


@query("date_from_text", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, epoch_ms(CAST(o_orderkey * 1500 AS BIGINT)) AS c FROM orders")
def date_from_text(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), datetimes.to_date(F.date_format(d, "dd/MM/yyyy"), "DD/MM/YYYY").alias("a"), datetimes.to_date(F.date_format(d, "yyyyMMdd"), "YYYYMMDD").alias("b"), datetimes.to_timestamp(F.col("o_orderkey") * 1.5).cast("timestamp_ntz").alias("c"))


_IV = "(SELECT event_id AS k, event_id % 31 AS m, event_id % 67 AS d, event_id % 101 AS h FROM events)"


def _intervals(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("k"), intervals.make_interval(months=k % 31, days=k % 67, hours=k % 101).alias("i"))


@query("interval_justify", f"SELECT k, m + d // 30 AS jd_m, d % 30 AS jd_d, d + h // 24 AS jh_d, (h % 24) * 3600000000 AS jh_u, m + (d + h // 24) // 30 AS ji_m, (d + h // 24) % 30 AS ji_d FROM {_IV}")
def interval_justify(spark, sf):
    i = _intervals(spark, sf).select("k", intervals.justify_days("i").alias("jd"), intervals.justify_hours("i").alias("jh"), intervals.justify_interval("i").alias("ji"))
    return i.select("k", *[F.col(c.replace("_", ".")).cast("long").alias(a) for c, a in (("jd_months", "jd_m"), ("jd_days", "jd_d"), ("jh_days", "jh_d"), ("jh_micros", "jh_u"), ("ji_months", "ji_m"), ("ji_days", "ji_d"))])


@query("interval_scale", f"SELECT k, 3 * m AS a, -d AS b, -h * 3600000000 AS c, m // 2 AS e, d // 2 + (m % 2) * 15 AS f, h * 1800000000 + (d % 2) * 43200000000 AS g FROM {_IV}")
def interval_scale(spark, sf):
    i = _intervals(spark, sf).select("k", intervals.mul("i", 3).alias("x"), intervals.neg("i").alias("n"), intervals.div("i", 2).alias("h"))
    return i.select("k", *[F.col(c).cast("long").alias(a) for c, a in (("x.months", "a"), ("n.days", "b"), ("n.micros", "c"), ("h.months", "e"), ("h.days", "f"), ("h.micros", "g"))])


@query("interval_extract", f"SELECT k, CAST(m // 12 AS DOUBLE) AS y, CAST(m % 12 AS DOUBLE) AS mo, CAST(d AS DOUBLE) AS d, CAST(h AS DOUBLE) AS h, CAST(m // 12 * 31557600 + m % 12 * 2592000 + d * 86400 + h * 3600 AS DOUBLE) AS e, m * 30 * 24 + d * 24 + h <= 240 * 24 AS le, m * 30 * 24 + d * 24 + h = 24 AS eq FROM {_IV}")
def interval_extract(spark, sf):
    x, c = intervals.extract, intervals.compare
    return _intervals(spark, sf).select("k", x("year", "i").alias("y"), x("month", "i").alias("mo"), x("day", "i").alias("d"), x("hour", "i").alias("h"), x("epoch", "i").alias("e"), c("i", "<=", intervals.literal("8 mons")).alias("le"), c("i", "=", intervals.literal("1 day")).alias("eq"))


_A = "(SELECT p_partkey AS k, list_filter([p_size, p_size % 7, 3, p_size % 3], lambda x: x <> 2) AS a FROM part)"


def _arrays(spark, sf):
    z = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), arrays.remove(F.array(z, z % 7, F.lit(3), z % 3), F.lit(2)).alias("a"))


@query("array_shape", f"SELECT k, len(a) AS n, 1 AS lo, CAST(len(a) AS INT) AS hi, 1 AS nd, '[1:' || len(a) || ']' AS ds, [[a[1], a[1], a[1]], [a[1], a[1], a[1]]] AS f, list_filter(range(1, len(a) + 1), lambda i: a[i] = 3) AS p, list_sort(a) AS sh, CAST(least(len(a), 2) AS INT) AS sa FROM {_A}")
def array_shape(spark, sf):
    g = arrays
    return _arrays(spark, sf).select("k", g.cardinality("a").cast("long").alias("n"), g.lower("a").alias("lo"), g.upper("a").alias("hi"), g.ndims("a").alias("nd"), g.dims("a").alias("ds"), g.fill(F.col("a")[0], [2, 3]).alias("f"), g.positions("a", 3).cast("array<bigint>").alias("p"), F.sort_array(g.shuffle("a")).alias("sh"), F.size(g.sample("a", 2)).alias("sa"))


@query("array_compare", f"SELECT k, list_min(a) >= 1 AS al, 40 > list_max(a) AS am, a < [9, 3] AS lt, a >= [5] AS ge, a = [3, 3] AS eq, '[' || array_to_string(a, ',') || ']' AS j FROM {_A}")
def array_compare(spark, sf):
    g, a, lit = arrays, F.col("a"), lambda *v: F.array(*map(F.lit, v))
    return _arrays(spark, sf).select("k", g.all_(1, "<=", "a").alias("al"), g.all_(40, ">", "a").alias("am"), (a < lit(9, 3)).alias("lt"), (a >= lit(5)).alias("ge"), (a == lit(3, 3)).alias("eq"), g.to_json("a").alias("j"))


@query("range_bounds", "SELECT p_partkey AS k, p_size % 2 = 0 AS li, p_size % 3 = 0 AND p_size % 5 <> 0 AS ui, p_size % 5 = 0 AS uinf, false AS linf, p_size + 0.5 AS a, CASE WHEN p_size % 5 <> 0 THEN p_size + 9.0 END AS b FROM part")
def range_bounds(spark, sf):
    z = F.col("p_size")
    text = F.concat(F.when(z % 2 == 0, "[").otherwise("("), z.cast("string"), F.lit(".5,"), F.when(z % 5 == 0, "").otherwise((z + 9).cast("string")), F.when((z % 3 == 0) & (z % 5 != 0), "]").otherwise(")"))
    p, g = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), ranges.from_text(text, "decimal(12,1)").alias("r")), ranges
    return p.select("k", g.lower_inc("r").alias("li"), g.upper_inc("r").alias("ui"), g.upper_inf("r").alias("uinf"), g.lower_inf("r").alias("linf"), g.lower("r").alias("a"), g.upper("r").alias("b"))


_V = "(SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_transform(embedding, lambda x: CAST(floor(x * 2) AS DOUBLE)) AS c, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0) AS q, (SELECT list_transform(embedding, lambda x: CAST(floor(x * 2) AS DOUBLE)) FROM embeddings WHERE vec_id = 0) AS d FROM embeddings)"


@query("vector_more", f"SELECT k, list_transform(list_zip(v, q), lambda z: round(z[1] - z[2], 6)) AS s, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS u, CAST(len(list_filter(list_zip(c, d), lambda z: z[1] <> z[2])) AS DOUBLE) AS h, round(1 - len(list_filter(list_zip(c, d), lambda z: z[1] = z[2] AND z[1] <> 0)) / len(list_filter(list_zip(c, d), lambda z: z[1] <> 0 OR z[2] <> 0)), 9) AS j, round(-list_inner_product(v, q), 9) AS n FROM {_V}")
def vector_more(spark, sf):
    e, g = table(spark, sf, "embeddings"), vectors
    coarse = lambda c: F.transform(F.col(c), lambda x: F.floor(x.cast("double") * 2).cast("double"))
    pairs = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")).join(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q"))))
    six = lambda c: F.transform(c, lambda x: maths.round_binary(x, 6))
    return pairs.select("k", six(g.sub("v", "q")).alias("s"), six(g.l2_normalize("v")).alias("u"), g.hamming_distance(coarse("v"), coarse("q")).alias("h"), F.round(g.jaccard_distance(coarse("v"), coarse("q")), 9).alias("j"), F.round(g.negative_inner_product("v", "q"), 9).alias("n"))


# the stemmer's table once more, as SQL over a word w without trailing s
_STEM = "CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN left(w, -3) || 'y' WHEN w LIKE '%es' AND len(w) > 4 THEN left(w, -2) WHEN w LIKE '%ing' AND len(w) > 5 THEN left(w, -3) WHEN w LIKE '%ly' AND len(w) > 4 THEN left(w, -2) WHEN w LIKE '%ed' AND len(w) > 4 THEN left(w, -2) WHEN w LIKE '%er' AND len(w) > 4 THEN left(w, -2) WHEN w LIKE '%ment' AND len(w) > 6 THEN left(w, -4) WHEN w LIKE '%ness' AND len(w) > 6 THEN left(w, -4) WHEN w LIKE '%tion' AND len(w) > 6 THEN left(w, -4) ELSE w END"


@query("fulltext_english", f"SELECT k, list_sort(list_distinct(list(x))) AS v FROM (SELECT k, {_STEM} AS x FROM (SELECT p_partkey AS k, rtrim(unnest(string_split(lower(p_type), ' ') || ['running', 'shipment', 'licenses']), 's') AS w FROM part)) GROUP BY k")
def fulltext_english(spark, sf):
    v = fulltext.to_tsvector(F.concat(F.lit("The running of "), F.col("p_type"), F.lit(", and its shipment; by licenses.")), "english")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.sort_array(F.map_keys(v)).alias("v"))


@query("fulltext_queries", "SELECT p_partkey AS k, p_type LIKE '%TIN%' AND p_type LIKE '%BRUSHED%' AS a, (p_type LIKE '%TIN%' OR p_type LIKE '%BRASS%') AND p_type NOT LIKE 'SMALL%' AS b, regexp_replace(p_type, '(TIN|BRASS)', '<b>\\1</b>', 'g') AS h FROM part")
def fulltext_queries(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_type", fulltext.to_tsvector("p_type").alias("v"))
    q = fulltext.to_tsquery("tin | brass")
    return p.select("k", fulltext.matches("v", fulltext.plainto_tsquery("the tin brushed")).alias("a"), (fulltext.matches("v", q) & fulltext.matches("v", fulltext.websearch_to_tsquery("-small"))).alias("b"), fulltext.ts_headline("p_type", q).alias("h"))


@query("geometry_shapes", "SELECT c_custkey AS k, c_custkey % 9 = 4 AS h, c_custkey % 7 = 3 AS v, c_custkey % 7 BETWEEN 1 AND 5 AND c_custkey % 9 BETWEEN 2 AND 6 AS i FROM customer")
def geometry_shapes(spark, sf):
    k = F.col("c_custkey")
    p, q, b = geometry.point(k % 7, k % 9), geometry.parse_point("(3,4)"), geometry.parse_box("(1,2),(5,6)")
    return table(spark, sf, "customer").select(k.alias("k"), geometry.is_horizontal(p, q).alias("h"), geometry.is_vertical(p, q).alias("v"), geometry.contains_point(b, p).alias("i"))


@query("json_contains_keys", """SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS INT) = 69 AS a, event_id % 3 = 1 AS b, json_extract_string(props, '$.k') || '|' || (event_id % 3) AS c FROM events""")
def json_contains_keys(spark, sf):
    e = F.col("event_id")
    j = jsonb.merge("props", F.concat(F.lit('{"m":'), (e % 3).cast("string"), F.lit("}")))
    return table(spark, sf, "events").select(e.alias("k"), jsonb.contains(j, '{"k": 69}').alias("a"), jsonb.contains(j, '{"m": 1}').alias("b"), F.concat_ws("|", jsonb.get_text(j, "k"), jsonb.get_text(j, "m")).alias("c"))


for _kind, _sql in (("min", "min(p_partkey)"), ("max", "max(p_partkey)"), ("count", "count(p_partkey)")):

    @query(f"window_exclude_{_kind}_groups", f"SELECT p_partkey, {_sql} OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a, {_sql} OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS b, {_sql} OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS c FROM part")
    def _exclude(spark, sf, kind=_kind):
        out = table(spark, sf, "part")
        for a, x, lo, hi, frame in (("a", "CURRENT ROW", -1, 1, "groups"), ("b", "TIES", -1, 1, "groups"), ("c", "GROUP", None, None, "rows")):
            out = windows.exclude_frame(out, kind, F.col("p_partkey"), a, ["p_brand"], ["p_size"], lo, hi, x, frame)
        return out.select("p_partkey", "a", "b", "c")


#: Texts that both dialects read alike.
for _name, _text in {
    "sql_natural_join": "SELECT n_name, r_name, r_regionkey FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) n NATURAL JOIN region",
    "sql_non_equi_join": "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON a.n_nationkey * 400 - 2000 > b.s_acctbal AND a.n_nationkey < b.s_nationkey",
    "sql_distinct_from": "SELECT c_custkey, nullif(c_nationkey, 3) IS DISTINCT FROM nullif(c_custkey % 25, 5) AS a, nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_custkey % 25, 3) AS b FROM customer",
    "sql_nested_set_operations": "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 5) UNION ALL ((SELECT s_nationkey FROM supplier) EXCEPT (SELECT c_nationkey FROM customer WHERE c_acctbal < 5000))",
    "sql_range_interval_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '60' DAY PRECEDING AND CURRENT ROW) AS n FROM orders",
}.items():
    _statements(_name, "", _text, _text)

_statements(
    "sql_create_alter_view",
    "CREATE TABLE big AS SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_totalprice > 200000; ALTER TABLE big ADD COLUMN y int DEFAULT 5; CREATE VIEW v AS SELECT k, x * 2 AS x, y FROM big; DELETE FROM big WHERE x > 300000",
    "SELECT k, x, y FROM v", "SELECT o_orderkey AS k, o_totalprice * 2 AS x, 5 AS y FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 300000",
)
_statements("sql_prepared", "PREPARE q AS SELECT c_custkey, c_name FROM customer WHERE c_nationkey = $1 AND c_acctbal > $2", "EXECUTE q(7, 100)", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100")
_statements(
    "sql_trigger",
    "CREATE TABLE n2 (k bigint, name text); CREATE FUNCTION fix() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.name := upper(NEW.name) || '!'; RETURN NEW; END $$; CREATE TRIGGER t BEFORE INSERT ON n2 FOR EACH ROW EXECUTE FUNCTION fix(); INSERT INTO n2 SELECT n_nationkey, lower(n_name) FROM nation",
    "SELECT k, name FROM n2", "SELECT n_nationkey AS k, upper(n_name) || '!' AS name FROM nation",
)
_statements("sql_settings", "SET work_mem = '4MB'", "SHOW work_mem", "SELECT '4MB' AS work_mem")
_statements(
    "sql_materialized_view",
    "CREATE TABLE s2 AS SELECT s_suppkey AS k, s_acctbal AS x FROM supplier; CREATE MATERIALIZED VIEW rich AS SELECT k, x FROM s2 WHERE x > 0; DELETE FROM s2 WHERE k > 5; CREATE MATERIALIZED VIEW few AS SELECT k, x FROM s2; DELETE FROM s2; INSERT INTO s2 VALUES (-1, 1.5); REFRESH MATERIALIZED VIEW few",
    "SELECT 'rich' AS v, k, x FROM rich UNION ALL SELECT 'few', k, x FROM few", "SELECT 'rich' AS v, s_suppkey AS k, s_acctbal AS x FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'few', -1, 1.5",
)
