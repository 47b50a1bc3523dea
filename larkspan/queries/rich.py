"""Ranges, vectors, geometry, full text, policies and streams of events."""

from pyspark.sql import functions as F

from larkspan.functions import fulltext, geometry, maths, ranges, vectors
from larkspan.operators import relational as rel
from larkspan.registry import query
from larkspan.session import table


def _ranges(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    lo, hi = z.cast("int"), (z + k % 20).cast("int")
    return table(spark, sf, "part").select(k.alias("k"), ranges.make(lo, hi, "int").alias("r"), ranges.literal("[20,30]", "int").alias("q"))


_R = "(SELECT p_partkey AS k, p_size AS lo, p_size + p_partkey % 20 AS hi, p_partkey % 20 = 0 AS e FROM part)"


@query("range_operators", f"SELECT k, NOT e AND lo <= 25 AND 25 < hi AS has, e OR (lo >= 20 AND hi <= 31) AS inside, NOT e AND lo < 31 AND hi > 20 AS over, NOT e AND hi <= 20 AS lft, NOT e AND lo >= 31 AS rgt, NOT e AND (hi = 20 OR lo = 31) AS adj, NOT e AND hi <= 31 AS nr, NOT e AND lo >= 20 AS nl FROM {_R}")
def range_operators(spark, sf):
    g = ranges
    return _ranges(spark, sf).select("k", g.contains_elem("r", 25).alias("has"), g.contained("r", "q").alias("inside"), g.overlaps("r", "q").alias("over"), g.left_of("r", "q").alias("lft"), g.right_of("r", "q").alias("rgt"), g.adjacent("r", "q").alias("adj"), g.not_right("r", "q").alias("nr"), g.not_left("r", "q").alias("nl"))


@query("range_fields", f"SELECT k, CASE WHEN e THEN 'empty' ELSE '[' || lo || ',' || hi || ')' END AS t, CASE WHEN NOT e THEN lo END AS a, CASE WHEN NOT e THEN CAST(hi AS INT) END AS b, e, NOT e AS li FROM {_R}")
def range_fields(spark, sf):
    g = ranges
    return _ranges(spark, sf).select("k", g.to_text("r").alias("t"), g.lower("r").alias("a"), g.upper("r").alias("b"), g.is_empty("r").alias("e"), g.lower_inc("r").alias("li"))


@query("range_dates", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) <= DATE '1997-03-01' AND DATE '1997-03-01' < CAST(o_orderdate AS DATE) + 31 AS has FROM orders")
def range_dates(spark, sf):
    d = F.col("o_orderdate").cast("date")
    r = ranges.make(d, F.date_add(d, 30), "date", "[]")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ranges.contains_elem(r, F.lit("1997-03-01").cast("date")).alias("has"))


_V = "(SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")).join(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q"))))


@query("vector_distances", f"SELECT k, round(list_distance(v, q), 9) AS l2, round(list_cosine_distance(v, q), 9) AS cos, round(list_inner_product(v, q), 9) AS ip, round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 9) AS l1, len(v) AS d FROM {_V}")
def vector_distances(spark, sf):
    g = vectors
    return _vectors(spark, sf).select("k", F.round(g.l2_distance("v", "q"), 9).alias("l2"), F.round(g.cosine_distance("v", "q"), 9).alias("cos"), F.round(g.inner_product("v", "q"), 9).alias("ip"), F.round(g.l1_distance("v", "q"), 9).alias("l1"), g.dims("v").cast("long").alias("d"))


@query("vector_arithmetic", f"SELECT k, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS n, list_transform(list_zip(v, q), lambda z: round(z[1] + z[2], 6)) AS a, list_transform(v[3:6], lambda x: round(x * 2, 6)) AS s FROM {_V}")
def vector_arithmetic(spark, sf):
    g = vectors
    six = lambda c: F.transform(c, lambda x: maths.round_binary(x, 6))
    return _vectors(spark, sf).select("k", maths.round_binary(g.l2_norm("v"), 9).alias("n"), six(g.add("v", "q")).alias("a"), six(g.mul(g.subvector("v", 3, 4), 2)).alias("s"))


@query(
    "vector_knn",
    "SELECT q, k FROM (SELECT a.vec_id AS q, b.vec_id AS k, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) b) WHERE rn <= 5",
)
def vector_knn(spark, sf):
    e = table(spark, sf, "embeddings")
    items = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("w"))
    return rel.knn(queries, items, vectors.l2_distance("v", "w"), ["q"], 5, ["k"]).select("q", "k")


@query("geometry_operators", "SELECT c_custkey AS k, round(sqrt(pow(x - 3, 2) + pow(y - 4, 2)), 9) AS d, x <= 5 AND x + 2 >= 1 AND y <= 5 AND y + 3 >= 1 AS o, x <= 2 AND y <= 2 AND x + 2 >= 3 AND y + 3 >= 3 AS c, x + 2 < 4 AS l, x > 5 AS r, y + 3 < 4 AS b, y > 5 AS a FROM (SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) AS x, CAST(c_custkey % 9 AS DOUBLE) AS y FROM customer)")
def geometry_operators(spark, sf):
    g, k = geometry, F.col("c_custkey")
    x, y = k % 7, k % 9
    c = table(spark, sf, "customer").select(k.alias("k"), g.point(x, y).alias("p"), g.box(x + 2, y + 3, x, y).alias("b"), g.parse_point("(3,4)").alias("q"), g.parse_box("(1,1),(5,5)").alias("o"), g.parse_box("((2,2),(3,3))").alias("i"), g.parse_box("4,4,5,5").alias("s"))
    return c.select("k", F.round(g.distance("p", "q"), 9).alias("d"), g.overlaps("b", "o").alias("o"), g.contains("b", "i").alias("c"), g.left_of("b", "s").alias("l"), g.right_of("b", "s").alias("r"), g.below("b", "s").alias("b"), g.above("b", "s").alias("a"))


_W = "(SELECT doc_id AS k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)"


@query("fulltext_match", f"SELECT k, list_contains(w, 'tion') AS a, list_contains(w, 'tion') AND NOT list_contains(w, 'edly') AS b, list_contains(w, 'queque') OR list_contains(w, 'license') AS c FROM {_W}")
def fulltext_match(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), fulltext.to_tsvector("text", "simple").alias("v"))
    m = lambda q: fulltext.matches("v", fulltext.to_tsquery(q, "simple"))
    return d.select("k", m("tion").alias("a"), m("tion & !edly").alias("b"), m("queque | license").alias("c"))


@query("fulltext_phrase", f"SELECT k, len(list_filter(range(1, len(w)), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')) > 0 AS p, (list_contains(w, 'apache')::INT + list_contains(w, 'license')::INT) / 2 AS r FROM {_W}")
def fulltext_phrase(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), fulltext.to_tsvector("text", "simple").alias("v"))
    return d.select("k", fulltext.matches("v", fulltext.phraseto_tsquery("general public license", "simple")).alias("p"), fulltext.ts_rank("v", fulltext.to_tsquery("apache & license", "simple")).alias("r"))
