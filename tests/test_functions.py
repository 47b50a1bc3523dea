"""Hand-computed values of the function library, with NULLs and edges."""

import datetime
import math

import pytest
from larkspan.functions import aggregates as agg
from larkspan.functions import arrays, datetimes, fulltext, geometry, intervals, jsonb, maths, ranges, vectors
from larkspan.functions import strings as s
from larkspan.operators import relational as rel
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1).select(
        F.lit("hello").alias("h"), F.lit(None).cast("string").alias("n"), F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3)).alias("a"), F.array().cast("array<int>").alias("e"), F.lit('{"a": {"b": [1, "x", null]}, "c": null}').alias("j")
    )

    def run(*cols):
        row = base.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(row) == 1 else tuple(row)

    return run


def test_strings(one):
    assert one(s.left("h", -10), s.right("h", -2), s.left("n", 2), s.concat("h", "n"), s.concat_op("h", "n")) == ("", "llo", None, "hello", None)
    assert one(s.chr_(F.lit(128512)), s.split_part("h", "l", -1), s.pad_left("h", 3, ""), s.format_("%s|%I|%L|%%", "n", "h", "n")) == ("😀", "o", "hel", "|hello|NULL|%")
    with pytest.raises(ValueError):
        s.split_part("h", "l", 0)
    assert one(s.encode("h", "hex"), s.encode("h", "base64")) == ("68656c6c6f", "aGVsbG8=")
    assert one(s.regexp_replace("h", "l", "<\\&>"), s.regexp_replace("h", "(h)(e)", "\\2\\1"), s.regexp_replace("h", "L", "x", "gi"), s.regexp_replace("h", "z", "x")) == ("he<l>lo", "ehllo", "hexxo", "hello")
    assert one(s.regexp_instr("h", "l", 1, 2), s.regexp_instr("h", "z"), s.regexp_substr("h", "l.", 1, 1), s.regexp_substr("h", "z"), s.regexp_count("h", "l", 4)) == (4, 0, "ll", None, 1)
    assert one(s.regexp_match("h", "(h)(e)"), s.regexp_match("h", "z"), s.regexp_match("h", "l+"), s.regexp_matches("h", "l")) == (["h", "e"], None, ["ll"], [["l"], ["l"]])
    assert one(s.similar_to("h", "h_l%"), s.similar_to("h", "hel"), s.similar_to("h", "(x|hello)")) == (True, False, True)
    assert one(s.to_number(F.lit("1,234.50-")), s.to_number(F.lit("<12>")), s.to_char_number(F.lit(1234.5), "FM9,999.00"), s.to_char_number(F.lit(-0.5), "990.00")) == (-1234.5, -12.0, "1,234.50", "  -0.50")
    assert one(s.uuid_version(F.lit("018f0000-0000-7000-8000-000000000000")), s.uuid_timestamp(F.lit("018f0000-0000-4000-8000-000000000000"))) == (7, None)
    assert s.like_escape("a!%b", "!") == "a\\%b"


def test_maths(one):
    assert one(maths.log(F.lit(1000)), maths.log(F.lit(8.0), 2), maths.trunc(F.lit(-1.29), 1), maths.int_div(F.lit(-7), F.lit(2)), maths.mod(F.lit(-7), F.lit(2))) == (3.0, pytest.approx(3.0), -1.2, -3, -1)
    assert one(maths.width_bucket(F.lit(5.35), 0.024, 10.06, 5), maths.width_bucket(F.lit(-1.0), 0, 10, 5), maths.width_bucket(F.lit(10.0), 0, 10, 5)) == (3, 0, 6)
    assert one(maths.trim_scale(F.lit("8.4100")), maths.trim_scale(F.lit("8.000"))) == ("8.41", "8")
    assert math.isnan(one(maths.parse_float(F.lit("NaN")))) and one(maths.parse_float(F.lit("-Infinity")), maths.parse_float(F.lit("x"))) == (-math.inf, None)
    assert one(maths.parse_bool(F.lit("Tr")), maths.parse_bool(F.lit("off")), maths.parse_bool("n"), maths.is_valid_input(F.lit("12x"), "int4")) == (True, False, None, False)
    with pytest.raises(Exception, match="invalid input syntax for type boolean"):
        one(maths.parse_bool(F.lit("maybe")))


def test_round_binary(one):
    a, b, c, d, e, n = one(*[maths.round_binary(F.lit(x), 6) for x in (-3e-7, 0.0078125, -0.0078125, 0.4999999e-6, 2.5e-6)], maths.round_binary(F.lit(None).cast("double")))
    assert math.copysign(1, a) == -1 and (a, b, c, d, e, n) == (0.0, 0.007813, -0.007813, 0.0, 3e-6, None)


def test_json_kinds(one):
    j = F.lit(' {"o": {}, "a": [1, 2], "s": "[1]", "t": true, "f": false, "z": null, "n": -1.5}')
    v = jsonb.parse(j)
    assert one(F.array(*[jsonb.typeof_at(v, [k]) for k in ("o", "a", "s", "t", "f", "z", "n", "none")])) == ["object", "array", "string", "boolean", "boolean", "null", "number", None]
    assert one(jsonb.typeof(j), jsonb.typeof(F.lit("nope")), jsonb.typeof(F.lit(" [")), jsonb.typeof("n"), jsonb.typeof(F.lit("\n[]"))) == ("object", None, None, None, "array")
    assert one(*[jsonb.array_length_at(v, [k]) for k in ("a", "s", "none")], jsonb.array_length_at(jsonb.parse("n"), ["a"])) == (2, 0, 0, None)
    assert one(jsonb.array_length("n"), jsonb.array_length(F.lit("{}")), jsonb.has_key("n", "a"), jsonb.has_key(F.lit("[]"), "a"), jsonb.has_all(j, ["o", "q"]), jsonb.has_any(F.lit("1"), ["q"])) == (None, 0, None, False, False, False)


def test_dates_and_intervals(one):
    t = F.lit("2024-02-29 23:30:15.25")
    assert one(datetimes.date_trunc("decade", t), datetimes.date_trunc("millennium", t), datetimes.date_trunc("week", t)) == (datetime.datetime(2020, 1, 1), datetime.datetime(2001, 1, 1), datetime.datetime(2024, 2, 26))
    assert one(datetimes.date_part("dow", t), datetimes.date_part("isodow", t), datetimes.date_part("second", t), datetimes.date_part("julian", F.lit("2000-01-01 12:00:00"))) == (4.0, 4.0, 15.25, 2451545.5)
    assert one(datetimes.date_bin("15 minutes", t), datetimes.date_bin("1 day", F.lit("1999-12-31 01:00:00"))) == (datetime.datetime(2024, 2, 29, 23, 30), datetime.datetime(1999, 12, 31))
    assert tuple(one(datetimes.age(F.lit("2001-04-10"), F.lit("1957-06-13")))) == (43 * 12 + 9, 27, 0)
    assert tuple(one(datetimes.age(F.lit("2024-01-01"), F.lit("2024-01-02 06:00:00")))) == (0, -1, -6 * intervals.HOUR)
    assert one(datetimes.to_date(F.lit("05 Dec 2000"), "DD Mon YYYY"), datetimes.to_timestamp(F.lit(1.5)).cast("string")) == (datetime.date(2000, 12, 5), "1970-01-01 00:00:01.5")
    assert one(datetimes.at_time_zone(F.lit("2024-01-01 12:00:00"), "EST"), datetimes.at_time_zone(F.lit("2024-07-01 12:00:00"), "Europe/Berlin")) == (datetime.datetime(2024, 1, 1, 7), datetime.datetime(2024, 7, 1, 14))
    with pytest.raises(ValueError):
        datetimes.date_part("fortnight", t)
    assert intervals.parse("1 year 2 mons 3 days 04:05:06.5") == (14, 3, 4 * intervals.HOUR + 5 * intervals.MINUTE + 6_500_000)
    assert intervals.parse("P1Y2M3DT4H") == (14, 3, 4 * intervals.HOUR) and intervals.parse("2 hours ago") == (0, 0, -2 * intervals.HOUR) and intervals.parse("1.5 months") == (1, 15, 0)
    with pytest.raises(ValueError):
        intervals.parse("3 parsecs")
    i = intervals.literal
    assert one(intervals.compare(i("1 mon"), "=", i("30 days")), intervals.compare(i("1 day"), "<", i("25 hours")), intervals.to_text(i("14 mons -3 days 26:00")), intervals.to_text(i("0 days"))) == (True, True, "1 year 2 mons -3 days 26:00:00", "00:00:00")
    assert tuple(one(intervals.mul(i("1 mon 1 day"), 1.5))) == (1, 16, 12 * intervals.HOUR)
    assert tuple(one(intervals.justify_interval(i("40 days 30 hours")))) == (1, 11, 6 * intervals.HOUR)
    assert one(intervals.plus(F.lit("2024-01-31"), i("1 mon")), intervals.extract("epoch", i("1 mon 1 day"))) == (datetime.datetime(2024, 2, 29), 2_678_400.0)


def test_arrays(one):
    assert arrays.parse_literal('{1,NULL,"a,b",{x,"y\\""}}') == ["1", None, "a,b", ["x", 'y"']]
    with pytest.raises(ValueError):
        arrays.parse_literal("{1,2")
    none = F.lit(None).cast("int")
    assert one(arrays.length("a"), arrays.length("e"), arrays.cardinality("e"), arrays.position("a", none), arrays.position("a", 9), arrays.positions("a", 3)) == (3, None, 0, 2, None, [3])
    assert one(arrays.remove("a", none), arrays.replace("a", none, 0), arrays.to_string("a", "-"), arrays.to_string("a", "-", "*"), arrays.sort("a"), arrays.sort("a", True)) == ([1, 3], [1, 0, 3], "1-3", "1-*-3", [1, 3, None], [None, 3, 1])
    assert one(arrays.overlap("a", F.array(none)), arrays.contains("a", "e"), arrays.trim("a", 9), arrays.dims("a"), arrays.fill(7, [2, 2]), arrays.subscript("a", 0)) == (True, True, [], "[1:3]", [[7, 7], [7, 7]], None)
    assert one(arrays.from_string("h", None), arrays.from_string("h", "l"), arrays.from_string("h", ""), arrays.from_string(F.lit(""), ",")) == (list("hello"), ["he", "", "o"], ["hello"], [])
    assert one(arrays.all_(2, ">", "e"), arrays.any_(2, "<", "a"), arrays.any_(9, "=", "a")) == (True, True, None)


def test_json(one):
    assert one(jsonb.get("j", "a"), jsonb.path("j", "{a,b,1}"), jsonb.path_text("j", "{a,b,1}"), jsonb.get("j", "c"), jsonb.get_text("j", "c"), jsonb.get("j", "z")) == ('{"b":[1,"x",null]}', '"x"', "x", "null", None, None)
    assert one(jsonb.contains("j", '{"a": {"b": ["x"]}}'), jsonb.contains("j", '{"a": 1}'), jsonb.contains(F.lit("[1,2]"), "[2]"), jsonb.contains(F.lit("[1,2]"), "2")) == (True, False, True, True)
    assert one(jsonb.delete_path("j", "{a,b,0}"), jsonb.merge(F.lit('{"a":1,"b":2}'), F.lit('{"b":3}')), jsonb.typeof(F.lit("[]")), jsonb.array_length("j"), jsonb.is_json(F.lit("{x"))) == ('{"a":{"b":["x",null]},"c":null}', '{"a":1,"b":3}', "array", 0, False)
    assert one(jsonb.has_key("j", "a"), jsonb.has_key(F.lit("[1]"), "a"), jsonb.has_all("j", ["a", "q"]), jsonb.path_exists("j", "$.a.b[*]")) == (True, False, False, True)


def test_aggregates_over_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "k int, v int")
    row = df.agg(agg.array_agg("v", "k").alias("a"), agg.string_agg("v", ",", "k").alias("s"), agg.bool_and(F.col("v") > 4).alias("b"), jsonb.array_agg_json("v", "k").alias("j"), agg.hypothetical_rank(5, "v").alias("r")).first()
    assert tuple(row) == ([None, 5, 4], "5,4", False, "[null,5,4]", 2)
    row = df.limit(0).agg(agg.array_agg("v", "k").alias("a"), agg.string_agg("v", ",").alias("s"), agg.bool_and(F.col("v") > 4).alias("b"), agg.bool_and(F.col("v") > 4, True).alias("t"), agg.hypothetical_percent_rank(5, "v").alias("p")).first()
    assert tuple(row) == (None, None, None, True, 0.0)
    dup = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", None)], "k int, n string, v int")
    assert dup.agg(jsonb.object_agg("n", "v", "k")).first()[0] == '{"a":2,"b":null}'
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (4.0, 4.0), (None, 9.0)], "x double, y double")
    got = xy.agg(agg.regr("count", "y", "x"), agg.regr("slope", "y", "x"), F.corr("x", "y"), agg.regr("intercept", "y", "x")).first()
    assert got[0] == 4 and [round(v, 9) for v in got[1:]] == [0.8, 0.8, 1.5]


def test_ranges(one):
    r = lambda t, k="int": ranges.literal(t, k)
    assert one(*[ranges.to_text(r(t)) for t in ("[10, 20]", "(30, 40)", "empty", "(,5]", "[3,3)")]) == ("[10,21)", "[31,40)", "empty", "(,6)", "empty")
    assert one(ranges.adjacent(r("[1,5)"), r("[5,9)")), ranges.overlaps(r("[1,5]"), r("[5,9)")), ranges.contains(r("[1,9)"), r("empty")), ranges.contains_elem(r("(1,2]", "double"), 1.0), ranges.left_of(r("[1,2]"), r("[3,4]")), ranges.upper_inf(r("[1,)"))) == (True, True, True, False, True, True)
    with pytest.raises(ValueError):
        ranges.literal("1,2", "int")
    with pytest.raises(Exception, match="lower bound"):
        one(ranges.to_text(ranges.make(5, 1, "int")))


def test_vectors_and_geometry(one):
    assert one(vectors.l2_distance("[1,2,3]", "[4,5,6]"), vectors.inner_product("[1,2,3]", "[4,5,6]"), vectors.l1_distance("[1,2]", "[3,1]"), vectors.cosine_distance("[1,0]", "[0,1]"), vectors.hamming_distance("[1,2]", "[1,3]"), vectors.jaccard_distance("[1,2,0]", "[1,3,0]")) == (pytest.approx(27**0.5), 32.0, 3.0, 1.0, 1.0, 0.5)
    with pytest.raises(Exception, match="different vector dimensions"):
        one(vectors.l2_distance("[1]", "[1,2]"))
    b = geometry.parse_box
    assert one(geometry.distance(geometry.parse_point("(1,2)"), geometry.parse_point("4,6")), geometry.overlaps(b("(0,0),(2,2)"), b("(2,2),(1,1)")), geometry.contains(b("0,0,4,4"), b("1,1,2,2")), geometry.above(b("(0,4),(2,6)"), b("(0,0),(2,2)"))) == (5.0, True, True, True)


def test_fulltext(one):
    text = F.lit("The quick brown foxes jumped over the lazy dogs")
    v = fulltext.to_tsvector(text)
    m = lambda q, f=fulltext.to_tsquery: fulltext.matches(v, f(q))
    assert one(fulltext.to_text(v)).startswith("'brown':3 'dog':9 'foxe':4 'jump':5")
    assert [fulltext.stem_word(w) for w in ("cities", "running", "happily", "walked", "dogs", "relational", "ss", "nation")] == ["citie", "runn", "happi", "walk", "dog", "relate", "", "nation"]
    assert one(m("fox & cat"), m("foxes | cat"), m("!cat"), m("quick <-> brown"), m("brown <-> quick"), m("quick <2> foxes")) == (False, True, True, True, False, True)
    assert one(m('"brown foxes" -cat', fulltext.websearch_to_tsquery), m("jumping dogs", fulltext.plainto_tsquery), m("over the lazy", fulltext.phraseto_tsquery)) == (True, True, True)
    assert one(fulltext.ts_rank(v, fulltext.to_tsquery("dog & cat")), fulltext.ts_headline(F.lit("a lazy Dog"), fulltext.to_tsquery("dogs"))) == (0.5, "a lazy <b>Dog</b>")
    assert fulltext.querytree(fulltext.to_tsquery("a1 & (b1 | !c1)")) == "'a1' & ( 'b1' | !'c1' )" and fulltext.numnode(fulltext.to_tsquery("aa & bb | cc")) == 5
    with pytest.raises(ValueError):
        fulltext.to_tsquery("a &")


def test_recursive_and_series(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    got = rel.recursive(spark.createDataFrame([(1,)], "n int"), lambda d: d.join(edges, d.n == edges.a).select(F.col("b").alias("n")), distinct=True)
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]
    assert rel.generate_series(spark, 5, 1).count() == 0
    with pytest.raises(ValueError):
        rel.generate_series(spark, 1, 2, 0)


def test_streaming_windows(spark, tmp_path):
    from larkspan.streaming.windows import latest, tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = tumbling(stream, "ts", "1 hour", ["event_type"], F.count("*").alias("n"))
    query = out.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = tumbling(events, "ts", "1 hour", ["event_type"], F.count("*").alias("n"))
    key = lambda df: sorted((r["bin"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("bins")) == key(want)
    assert latest(events, "ts", ["user_id"], "event_id").count() == events.select("user_id").distinct().count()
