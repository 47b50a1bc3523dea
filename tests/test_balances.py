"""Queries over customers' balances that the sample tables lack, against their DuckDB twins."""

import random

import duckdb
import pytest
from larkspan import registry
from larkspan.functions import strings as s

BALANCES = [0.0, -0.0, -0.001, 0.004, -0.00004, 0.125, 0.375, 1.005, 9.995, -9.995, 1.03125, 0.00499999999996, 100.0, -999.99, 9999.99, 4764.855, None]


@pytest.fixture(scope="module")
def customers(tmp_path_factory):
    rng = random.Random(4)
    rows = BALANCES + [round(rng.uniform(-1000, 10000), rng.randrange(6)) for _ in range(3000)] + [rng.randrange(-9000, 9000) / 2 ** rng.randrange(8) for _ in range(3000)]
    top = tmp_path_factory.mktemp("balances")
    values = ", ".join(f"({k}, {'NULL' if x is None else repr(x)}::DOUBLE)" for k, x in enumerate(rows)).replace("-0.0::", "'-0.0'::")
    duckdb.sql(f"COPY (SELECT k::BIGINT AS c_custkey, x AS c_acctbal FROM (VALUES {values}) t(k, x)) TO '{top}/customer.parquet'")
    return str(top)


def same(spark, sf, name):
    got = [tuple(r) for r in registry.QUERIES[name](spark, sf).orderBy("k").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    return got, con.execute(f"SELECT * FROM ({registry.ORACLE[name]}) ORDER BY k").fetchall()


def test_fixed_rounds_as_printf(spark):
    rng = random.Random(5)
    xs = [x for x in BALANCES if x is not None] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 9) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for places in (0, 2, 4):
        got = df.select("x", s.fixed("x", places).alias("a"), s.grouped("x", places).alias("b")).collect()
        assert all((r.a, r.b) == (f"{r.x:.{places}f}", f"{r.x:,.{places}f}") for r in got)
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, None)], "k int, x double")
    assert [r[0] for r in odd.orderBy("k").select(s.fixed("x", 2)).collect()] == ["NaN", "Infinity", "-Infinity", None]


def test_trimmed_balances_match_the_twin(spark, customers):
    got, want = same(spark, customers, "math_special")
    assert got == want and got[1][4] == "-0"


def test_shown_balances_match_the_twin(spark, customers):
    got, want = same(spark, customers, "num_to_char")
    assert got == want and got[1][1:3] == ("          -0.00", "-0.00")


def test_to_char_signs_and_rounding(spark):
    df = spark.sql("SELECT -0.001D AS d, CAST(-0.001 AS DECIMAL(9,3)) AS n, -7 AS i, 0.125D AS h, CAST(0.125 AS DECIMAL(9,3)) AS g, CAST(-0.0 AS FLOAT) AS f, CAST(NULL AS DOUBLE) AS z, -1234567.5D AS w, CAST('-Infinity' AS DOUBLE) AS y")
    got = df.select(*[s.to_char_number(c, "FM999,999,990.00") for c in "dnihgfzwy"]).first()
    assert tuple(got) == ("-0.00", "0.00", "-7.00", "0.12", "0.13", "0.00", None, "-1,234,567.50", "-Infinity")
