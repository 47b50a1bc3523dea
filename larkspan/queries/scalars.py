"""Scalar function families: strings, numbers, dates, intervals, JSON, arrays."""

from pyspark.sql import functions as F

from larkspan.functions import arrays, datetimes, intervals, jsonb, maths
from larkspan.functions import strings as s
from larkspan.registry import query
from larkspan.session import table


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("h"))


_P = "(SELECT page_id, url, url AS h FROM pages)"


@query("str_basics", f"SELECT page_id, lower(upper(h)) AS a, length(url) AS b, replace(url, 'http', 'x') AS c, substr(url, 3, 5) AS d, trim('htps/' FROM h) AS e, ltrim(url, 'htp:/') AS f, rtrim(url, 'x=&') AS g FROM {_P}")
def str_basics(spark, sf):
    u, h = F.col("url"), F.col("h")
    return _pages(spark, sf).select("page_id", F.lower(F.upper(h)).alias("a"), F.length(u).cast("long").alias("b"), F.replace(u, F.lit("http"), F.lit("x")).alias("c"), F.substring(u, 3, 5).alias("d"), F.btrim(h, F.lit("htps/")).alias("e"), F.ltrim(u, F.lit("htp:/")).alias("f"), F.rtrim(u, F.lit("x=&")).alias("g"))


@query("str_concat", f"SELECT page_id, concat(h, nullif(page_id, 3), '!') AS a, h || nullif(url, url) AS b, concat_ws('-', h, nullif(page_id, 3), 'z') AS c FROM {_P}")
def str_concat(spark, sf):
    n = F.nullif("page_id", F.lit(3).cast("long"))
    return _pages(spark, sf).select("page_id", s.concat("h", n, F.lit("!")).alias("a"), s.concat_op("h", F.nullif("url", "url")).alias("b"), F.concat_ws("-", "h", n.cast("string"), F.lit("z")).alias("c"))


@query("str_left_right", f"SELECT page_id, left(h, 3) AS a, left(h, -4) AS b, right(h, 3) AS c, right(h, -4) AS d, left(h, -40) AS e, right(h, -40) AS f FROM {_P}")
def str_left_right(spark, sf):
    return _pages(spark, sf).select("page_id", s.left("h", 3).alias("a"), s.left("h", -4).alias("b"), s.right("h", 3).alias("c"), s.right("h", -4).alias("d"), s.left("h", -40).alias("e"), s.right("h", -40).alias("f"))


@query("str_pad_repeat", f"SELECT page_id, lpad(h, 20, 'ab') AS a, lpad(h, 120, 'ab') AS a2, rpad(h, 5, '*') AS b, rpad(h, 120, '*+') AS b2, repeat(left(h, 2), 3) AS c, reverse(h) AS d, translate(h, 'the', 'TH') AS e, chr(CAST(913 + page_id % 20 AS INT)) AS f, chr(128512) AS g FROM {_P}")
def str_pad_repeat(spark, sf):
    return _pages(spark, sf).select("page_id", s.pad_left("h", 20, "ab").alias("a"), s.pad_left("h", 120, "ab").alias("a2"), s.pad_right("h", 5, "*").alias("b"), s.pad_right("h", 120, "*+").alias("b2"), F.repeat(s.left("h", 2), F.lit(3)).alias("c"), F.reverse("h").alias("d"), F.translate("h", "the", "TH").alias("e"), s.chr_(F.col("page_id") % 20 + 913).alias("f"), s.chr_(F.lit(128512)).alias("g"))


@query("str_parts", f"SELECT page_id, split_part(url, '/', 3) AS a, split_part(url, '/', -1) AS b, split_part(url, '/', 40) AS c, strpos(url, 'example') AS d, position('zzz' IN url) AS e, left(h, 2) || 'NEW' || substr(h, 6) AS f, initcap AS g, md5(h) AS i, ascii(h) AS j FROM (SELECT *, upper(left(h, 1)) || lower(substr(h, 2)) AS initcap FROM (SELECT page_id, url, split_part(substr(url, 8), '.', 1) AS h FROM pages))")
def str_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", s.split_part(F.substring("url", F.lit(8), F.length("url")), ".", 1).alias("h"))
    return p.select("page_id", s.split_part("url", "/", 3).alias("a"), s.split_part("url", "/", -1).alias("b"), s.split_part("url", "/", 40).alias("c"), s.strpos("url", "example").cast("long").alias("d"), s.strpos("url", "zzz").cast("long").alias("e"), s.overlay("h", "NEW", 3, 3).alias("f"), F.initcap("h").alias("g"), F.md5("h").alias("i"), F.ascii("h").alias("j"))


@query("str_format", f"SELECT page_id, 'page ' || page_id || ': ' || h || ' 100%' AS a FROM {_P}")
def str_format(spark, sf):
    return _pages(spark, sf).select("page_id", s.format_("page %s: %s 100%%", "page_id", "h").alias("a"))


@query("str_encode", f"SELECT page_id, lower(hex(encode(h))) AS a, rtrim(regexp_replace(to_base64(encode(h)), '(.{{76}})', '\\1' || chr(10), 'g'), chr(10)) AS b, decode(from_hex(hex(encode(h)))) AS c FROM {_P}")
def str_encode(spark, sf):
    return _pages(spark, sf).select("page_id", s.encode("h", "hex").alias("a"), s.encode("h", "base64").alias("b"), F.decode(s.decode(s.encode("h", "hex"), "hex"), "UTF-8").alias("c"))


@query("regex_replace", f"SELECT page_id, regexp_replace(url, '[aeiou]', '#') AS a, regexp_replace(url, '[aeiou]', '#', 'g') AS b, regexp_replace(url, '(\\w+)\\.(\\w+)', '\\2.\\1') AS c, regexp_replace(url, 'EXAMPLE', 'X', 'i') AS d, regexp_replace(url, 'zzz+', 'X') AS e FROM {_P}")
def regex_replace(spark, sf):
    return _pages(spark, sf).select("page_id", s.regexp_replace("url", "[aeiou]", "#").alias("a"), s.regexp_replace("url", "[aeiou]", "#", "g").alias("b"), s.regexp_replace("url", r"(\w+)\.(\w+)", r"\2.\1").alias("c"), s.regexp_replace("url", "EXAMPLE", "X", "i").alias("d"), s.regexp_replace("url", "zzz+", "X").alias("e"))


@query("regex_find", f"SELECT page_id, len(regexp_extract_all(url, 'a.')) AS a, nullif(regexp_extract(url, '\\d+'), '') AS b, regexp_extract_all(url, '\\w+')[2] AS c, regexp_matches(url, '^https') AS d, regexp_split_to_array(url, '[/.]+') AS e, regexp_extract_all(url, '([a-z]+)=') AS f FROM {_P}")
def regex_find(spark, sf):
    return _pages(spark, sf).select("page_id", s.regexp_count("url", "a.").cast("long").alias("a"), s.regexp_substr("url", r"\d+").alias("b"), s.regexp_substr("url", r"\w+", 1, 2).alias("c"), s.regexp_like("url", "^https").alias("d"), s.regexp_split_to_array("url", "[/.]+").alias("e"), F.transform(s.regexp_matches("url", "([a-z]+=)"), lambda m: m[0]).alias("f"))


@query("regex_position", f"SELECT page_id, strpos(url, '/') AS a, strpos(url, '/') + strpos(substr(url, strpos(url, '/') + 1), '/') AS b FROM {_P}")
def regex_position(spark, sf):
    return _pages(spark, sf).select("page_id", s.regexp_instr("url", "/").cast("long").alias("a"), s.regexp_instr("url", "/", 1, 2).cast("long").alias("b"))


_C = "(SELECT c_custkey AS k, c_acctbal AS x, CAST(c_custkey % 13 - 6 AS INT) AS i FROM customer)"


def _nums(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 13 - 6).cast("int").alias("i"))


@query("math_basics", f"SELECT k, abs(x) AS a, floor(x) AS b, ceil(x) AS c, round(x, 1) AS d, round(sqrt(abs(x)), 6) AS e, round(exp(x / 10000), 8) AS f, round(pow(abs(x), 0.3), 6) AS g, round(log(abs(x) + 1), 8) AS h, round(ln(abs(x) + 1), 8) AS l, sign(x) AS m FROM {_C}")
def math_basics(spark, sf):
    x = F.col("x")
    r = F.round
    return _nums(spark, sf).select("k", F.abs(x).alias("a"), F.floor(x).cast("double").alias("b"), F.ceil(x).cast("double").alias("c"), r(x, 1).alias("d"), r(F.sqrt(F.abs(x)), 6).alias("e"), r(F.exp(x / 10000), 8).alias("f"), r(maths.power(F.abs(x), 0.3), 6).alias("g"), r(maths.log(F.abs(x) + 1), 8).alias("h"), r(maths.ln(F.abs(x) + 1), 8).alias("l"), F.signum(x).cast("tinyint").alias("m"))


@query("math_integer", f"SELECT k, CAST(trunc(i / 4) AS BIGINT) AS a, i % 4 AS b, trunc(x) AS c, gcd(abs(i), 4) AS d FROM {_C}")
def math_integer(spark, sf):
    gcd = F.when(F.col("i") % 4 == 0, 4).when(F.col("i") % 2 == 0, 2).otherwise(1).cast("int")
    return _nums(spark, sf).select("k", maths.int_div("i", F.lit(4)).alias("a"), maths.mod("i", F.lit(4)).alias("b"), maths.trunc("x").alias("c"), gcd.alias("d"))


@query("math_width_bucket", f"SELECT k, CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 9000 THEN 10 ELSE floor(x / 1000) + 1 END AS INT) AS w, CAST(CASE WHEN x > 9000 THEN 0 WHEN x <= 0 THEN 10 ELSE floor((9000 - x) / 1000) + 1 END AS INT) AS v FROM {_C}")
def math_width_bucket(spark, sf):
    return _nums(spark, sf).select("k", maths.width_bucket("x", 0, 9000, 9).alias("w"), maths.width_bucket("x", 9000, 0, 9).alias("v"))


@query("math_greatest_least", f"SELECT k, greatest(x, i, 5) AS g, least(x, nullif(i, 2), 5) AS l, nullif(i, 0) AS n FROM {_C}")
def math_greatest_least(spark, sf):
    i = F.col("i").cast("double")
    return _nums(spark, sf).select("k", F.greatest("x", i, F.lit(5.0)).alias("g"), F.least("x", F.nullif(i, F.lit(2.0)), F.lit(5.0)).alias("l"), F.nullif("i", F.lit(0)).alias("n"))


_E = "(SELECT event_id AS k, ts FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), "ts")


_TRUNC = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@query("date_trunc", "SELECT k, " + ", ".join(f"CAST(date_trunc('{f}', ts) AS TIMESTAMP) AS {f}_" for f in _TRUNC) + f", make_timestamp(2001, 1, 1, 0, 0, 0.0) AS century_, make_timestamp(2020, 1, 1, 0, 0, 0.0) AS decade_ FROM {_E}")
def date_trunc(spark, sf):
    return _events(spark, sf).select("k", *[datetimes.date_trunc(f, "ts").alias(f"{f}_") for f in (*_TRUNC, "century", "decade")])


_PARTS = ("dow", "isodow", "doy", "week", "year", "quarter", "month", "day", "hour", "minute", "decade", "century", "millennium", "isoyear")


@query("date_part", "SELECT k, " + ", ".join(f"CAST(date_part('{f}', ts) AS DOUBLE) AS {f}_" for f in _PARTS) + f", round(epoch(ts), 3) AS epoch_, round(date_part('second', ts) + (epoch_us(ts) % 1000000) / 1000000, 6) AS second_ FROM {_E}")
def date_part(spark, sf):
    return _events(spark, sf).select("k", *[datetimes.date_part(f, "ts").alias(f"{f}_") for f in _PARTS], F.round(datetimes.date_part("epoch", "ts"), 3).alias("epoch_"), F.round(datetimes.date_part("second", "ts"), 6).alias("second_"))


@query("date_bin", f"SELECT k, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01 00:02:30') AS a, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2030-01-01') AS b FROM {_E}")
def date_bin(spark, sf):
    return _events(spark, sf).select("k", datetimes.date_bin("15 minutes", "ts", "2000-01-01 00:02:30").alias("a"), datetimes.date_bin("1 week", "ts", "2030-01-01").alias("b"))


@query("date_interval", "SELECT o_orderkey AS k, o_orderdate + INTERVAL '1 month 3 days 02:30:00' AS a, o_orderdate - INTERVAL '90 minutes' AS b, CAST(o_orderdate AS DATE) AS c, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS d, make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6.5) AS e FROM orders")
def date_interval(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), intervals.plus(d, intervals.literal("1 month 3 days 02:30:00")).alias("a"), intervals.plus(d, intervals.literal("90 minutes"), -1).alias("b"), d.cast("date").alias("c"), datetimes.to_char(d, "DD/MM/YYYY HH24:MI").alias("d"), datetimes.make_timestamp(F.year(d), 2, 3, 4, 5, 6.5).alias("e"))


@query("date_age", "SELECT o_orderkey AS k, datepart('year', a) * 12 + datepart('month', a) AS months, datepart('day', a) AS days FROM (SELECT o_orderkey, age(TIMESTAMP '2001-02-15', o_orderdate) AS a FROM orders)")
def date_age(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), datetimes.age(F.lit("2001-02-15"), "o_orderdate").alias("a"))
    return o.select("k", F.col("a.months").cast("long").alias("months"), F.col("a.days").cast("long").alias("days"))


@query("interval_arithmetic", "SELECT k, 14 + m AS months, 5 - k % 3 AS days, 5400000000 AS micros, (14 + m) * 30 + 5 - k % 3 > 500 AS longer FROM (SELECT n_nationkey AS k, n_nationkey % 5 AS m FROM nation)")
def interval_arithmetic(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5).alias("m"))
    i = intervals.sub(intervals.add(intervals.literal("1 year 2 mons 5 days 01:30"), intervals.make_interval(months="m")), intervals.make_interval(days=F.col("k") % 3))
    out = n.select("k", i.alias("i"))
    return out.select("k", "i.months", "i.days", "i.micros", intervals.compare("i", ">", intervals.literal("500 days 01:30")).alias("longer"))


_J = """(SELECT event_id AS k, '{"a": {"b": [1, "two", null, {"c": ' || user_id || '}]}, "s": "x' || user_id || '", "n": ' || event_id || ', "t": true, "z": null}' AS j FROM events)"""


def _json(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = F.concat(F.lit('{"a": {"b": [1, "two", null, {"c": '), u, F.lit('}]}, "s": "x'), u, F.lit('", "n": '), e, F.lit(', "t": true, "z": null}'))
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), text.alias("j"))


@query("json_access", f"SELECT k, CAST(json_extract(j, '$.s') AS VARCHAR) AS a, json_extract_string(j, '$.s') AS b, CAST(json_extract(j, '$.a.b[1]') AS VARCHAR) AS c, json_extract_string(j, '$.a.b[3].c') AS d, CAST(json_extract(j, '$.n') AS VARCHAR) AS e, json_extract_string(j, '$.nope') AS f FROM {_J}")
def json_access(spark, sf):
    return _json(spark, sf).select("k", jsonb.get("j", "s").alias("a"), jsonb.get_text("j", "s").alias("b"), jsonb.path("j", "{a,b,1}").alias("c"), jsonb.path_text("j", "{a,b,3,c}").alias("d"), jsonb.get("j", "n").alias("e"), jsonb.get_text("j", "nope").alias("f"))


@query("json_inspect", f"SELECT k, CASE json_type(j, '$.' || f) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS t, json_keys(j) AS keys, json_array_length(j, '$.a.b') AS n, true AS has, false AS no, json_exists(j, '$.' || f) AS any_ FROM {_J}, (VALUES ('s'), ('t'), ('z'), ('a'), ('n')) v(f)")
def json_inspect(spark, sf):
    j = _json(spark, sf).withColumn("v", jsonb.parse("j"))  # parsed once for all paths
    once = j.select("k", F.array(*[jsonb.typeof_at("v", [f]) for f in "stzan"]).alias("types"), jsonb.keys("j").alias("keys"), jsonb.array_length_at("v", ["a", "b"]).cast("long").alias("n"), jsonb.has_all("j", ["a", "z"]).alias("has"), jsonb.has_key("j", "b").alias("no"), jsonb.has_any("j", ["q", "s"]).alias("any_"))
    # never empty, so outer gives the same rows; a plain explode would work the array out once more in the filter that Spark infers
    return once.select("k", F.explode_outer("types").alias("t"), "keys", "n", "has", "no", "any_")


@query("json_contains", """SELECT event_id AS k, json_extract_string(props, '$.k') = '69' AS a, true AS b FROM events""")
def json_contains(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), jsonb.contains("props", '{"k": 69}').alias("a"), jsonb.contains("props", "{}").alias("b"))


@query("json_build", """SELECT n_nationkey AS k, '{"name":"' || n_name || '","none":null,"key":' || n_nationkey || '}' AS a, '["' || n_name || '",' || n_nationkey || ',null]' AS b FROM nation""")
def json_build(spark, sf):
    n = table(spark, sf, "nation")
    none = F.lit(None).cast("string")
    return n.select(F.col("n_nationkey").alias("k"), jsonb.build_object("name", F.col("n_name"), "none", none, "key", F.col("n_nationkey")).alias("a"), jsonb.build_array(F.col("n_name"), F.col("n_nationkey"), none).alias("b"))


@query("json_change", """SELECT event_id AS k, '{"k":' || json_extract_string(props, '$.k') || ',"x":1}' AS a, '{}' AS b, '[1,3]' AS c FROM events""")
def json_change(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("k"), jsonb.merge("props", F.lit('{"x": 1}')).alias("a"), jsonb.delete_key("props", "k").alias("b"), jsonb.delete_index(F.lit("[1,2,3]"), 1).alias("c"))


@query("json_elements", "SELECT n_nationkey AS k, v FROM nation, (VALUES ('1'), ('\"b\"'), ('null'), ('{\"c\":2}')) t(v)")
def json_elements(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.explode(jsonb.elements(F.lit('[1, "b", null, {"c": 2}]'))).alias("v"))


_A = "(SELECT p_partkey AS k, [p_size, p_size % 7, 3, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 9 END] AS a FROM part)"


def _arrays(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(k.alias("k"), F.array(z, z % 7, F.lit(3), F.when(k % 4 != 0, 9)).alias("a"))


@query("array_set_operators", f"SELECT k, list_has_any(list_filter(a, lambda x: x IS NOT NULL), [3, 100]) AS ov, list_has_all(list_filter(a, lambda x: x IS NOT NULL), [3, 9]) AS co, list_contains(a, 5) AS an FROM (SELECT k, list_filter(a, lambda x: x IS NOT NULL) AS a FROM {_A})")
def array_set_operators(spark, sf):
    a = _arrays(spark, sf).withColumn("b", arrays.remove("a", F.lit(None).cast("int")))
    return a.select("k", arrays.overlap("a", F.array(F.lit(3), F.lit(100))).alias("ov"), arrays.contains("a", F.array(F.lit(3), F.lit(9))).alias("co"), arrays.any_(5, "=", "b").alias("an"))


@query("array_edit", f"SELECT k, list_append(a, 1) AS ap, list_prepend(0, a) AS pr, list_concat(a, [7, 8]) AS ca, list_filter(a, lambda x: x IS DISTINCT FROM 3) AS re, list_transform(a, lambda x: CASE WHEN x = 3 THEN 33 ELSE x END) AS rp, a[2:3] AS sl, a[1:2] AS tr, list_reverse(a) AS rv FROM {_A}")
def array_edit(spark, sf):
    return _arrays(spark, sf).select("k", arrays.append("a", 1).alias("ap"), arrays.prepend(0, "a").alias("pr"), arrays.cat("a", F.array(F.lit(7), F.lit(8))).alias("ca"), arrays.remove("a", 3).alias("re"), arrays.replace("a", 3, 33).alias("rp"), arrays.slice_("a", 2, 3).alias("sl"), arrays.trim("a", 2).alias("tr"), arrays.reverse("a").alias("rv"))


@query("array_measure", f"SELECT k, len(a) AS n, list_position(a, 3) AS p, list_position(a, NULL) AS q, array_to_string(a, ',') AS s, a[1] AS first_, a[9] AS none_, list_sort(a, 'ASC', 'NULLS LAST') AS up, list_sort(a, 'DESC', 'NULLS FIRST') AS down FROM {_A}")
def array_measure(spark, sf):
    a = _arrays(spark, sf)
    return a.select("k", arrays.length("a").cast("long").alias("n"), arrays.position("a", 3).alias("p"), arrays.position("a", F.lit(None).cast("int")).alias("q"), arrays.to_string("a", ",").alias("s"), arrays.subscript("a", 1).alias("first_"), arrays.subscript("a", 9).alias("none_"), arrays.sort("a").alias("up"), arrays.sort("a", descending=True).alias("down"))


@query("array_text", f"SELECT page_id, string_split(url, '/') AS a, unnest(string_split(h, '.')) AS b FROM {_P}")
def array_text(spark, sf):
    return _pages(spark, sf).select("page_id", arrays.from_string("url", "/").alias("a"), F.explode(arrays.from_string("h", ".")).alias("b"))
