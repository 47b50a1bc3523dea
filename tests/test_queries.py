"""Every registered query against its DuckDB twin at sf0.001."""

import datetime
import decimal
import math

import duckdb
import pytest
from larkspan import registry
from larkspan.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if hasattr(v, "asDict"):
        return norm(v.asDict(True))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([norm(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_its_twin(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = table_of(df.columns, df.collect())
    cursor = con.execute(registry.ORACLE[name])
    assert got == table_of([d[0] for d in cursor.description], cursor.fetchall())


def test_plans_are_native_and_pruned(spark):
    """No Python in the library's plans; scans read what they need and get the filters."""
    for name in registry.QUERIES:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan, name
    plan = registry.QUERIES["join_inner"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan and "o_orderdate" not in plan
    plan = registry.QUERIES["rls_policies"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(c_n" in plan
    plan = registry.QUERIES["distinct_on"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
