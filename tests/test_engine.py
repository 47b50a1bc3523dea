import datetime
from decimal import Decimal

import pytest
from larkspan.plans.dialect import lex, split_statements, to_spark
from larkspan.plans.engine import CheckViolation, Engine, TransactionAborted
from larkspan.plans.policy import PermissionDenied


@pytest.fixture()
def db(spark):
    return Engine(spark)


@pytest.fixture()
def emp(db):
    db.sql("CREATE TABLE employees (id serial PRIMARY KEY, name text NOT NULL, department text, salary numeric(10,2), hire_date date)")
    db.sql("""INSERT INTO employees (name, department, salary, hire_date) VALUES
        ('Alice','Eng',90000,'2020-01-15'), ('Bob','Eng',85000,'2021-03-20'), ('Charlie','Eng',95000,'2019-06-10'), ('Diana','Sales',80000,'2020-09-01'),
        ('Eve','Sales',75000,'2021-07-15'), ('Frank','Sales',85000,'2020-04-22'), ('Grace','Marketing',70000,'2022-01-10'), ('Henry','Marketing',72000,'2021-11-05')""")
    return db


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_serial_and_select(emp):
    assert sorted(r[0] for r in rows(emp.sql("SELECT id FROM employees"))) == list(range(1, 9))
    assert rows(emp.sql("SELECT name FROM employees WHERE department = 'Eng' ORDER BY salary DESC LIMIT 2")) == [("Charlie",), ("Alice",)]
    assert rows(emp.sql("SELECT department, count(*) AS n, max(salary) FROM employees GROUP BY department HAVING count(*) > 2 ORDER BY 1")) == [("Eng", 3, Decimal("95000.00")), ("Sales", 3, Decimal("85000.00"))]


def test_distinct_on_and_windows(emp):
    got = rows(emp.sql("SELECT DISTINCT ON (department) department, name FROM employees ORDER BY department, salary DESC"))
    assert got == [("Eng", "Charlie"), ("Marketing", "Henry"), ("Sales", "Frank")]
    got = rows(emp.sql("SELECT name, rank() OVER w FROM employees WINDOW w AS (PARTITION BY department ORDER BY salary DESC) ORDER BY department, 2, name"))
    assert got[:3] == [("Charlie", 1), ("Alice", 2), ("Bob", 3)]
    assert rows(emp.sql("SELECT x.d FROM (SELECT DISTINCT ON (department) department AS d, salary FROM employees ORDER BY department, salary) x WHERE x.salary > 72000 ORDER BY 1")) == [("Eng",), ("Sales",)]


def test_aggregates(emp):
    assert rows(emp.sql("SELECT string_agg(name, ', ' ORDER BY name) FROM employees WHERE department = 'Eng'")) == [("Alice, Bob, Charlie",)]
    assert rows(emp.sql("SELECT array_agg(name ORDER BY salary) FROM employees WHERE department = 'Sales'")) == [(["Eve", "Diana", "Frank"],)]
    assert rows(emp.sql("SELECT rank(80000) WITHIN GROUP (ORDER BY salary), count(DISTINCT department), count(*) FILTER (WHERE salary > 80000) FROM employees")) == [(4, 3, 4)]


def test_expressions(db):
    one = lambda q: rows(db.sql("SELECT " + q))[0]
    assert one("1::text, '{1,2,3}'::int[], ARRAY['a','b'], (ARRAY[5,6,7])[2], (ARRAY[5,6,7])[2:3]") == ("1", [1, 2, 3], ["a", "b"], 6, [6, 7])
    assert one("'abc' ~ 'B', 'abc' ~* 'B', 'abc' !~ 'x', 'abc' SIMILAR TO 'a(b|x)%', 'aXc' LIKE 'a_c'") == (False, True, True, True, True)
    assert one("""'{"a": {"b": [1, "x"]}}' -> 'a' -> 'b' ->> 1, '{"a": {"b": [1, "x"]}}' #> '{a,b}', '{"a": 1, "b": 2}' @> '{"a": 1}', '{"a": 1}' ? 'b'""") == ("x", '[1,"x"]', True, False)
    assert one("ARRAY[1,2,3] @> ARRAY[2], ARRAY[1,2] && ARRAY[3], 2 = ANY(ARRAY[1,2]), 3 > ALL(ARRAY[1,2]), 5 BETWEEN SYMMETRIC 9 AND 1") == (True, False, True, True, True)
    assert one("left('hello', -2), right('hello', -2), split_part('a-b-c', '-', 2), concat('a', NULL, 1), regexp_replace('foofoo', 'o+', '0'), regexp_replace('foofoo', 'o+', '0', 'g'), strpos('abc', 'c'), chr(945)") == ("hel", "llo", "b", "a1", "f0foo", "f0f0", 3, "α")
    assert one("extract(dow FROM timestamp '2024-01-07 10:00:00'), extract(isodow FROM timestamp '2024-01-07 10:00:00'), date_trunc('century', timestamp '2024-05-01 00:00:00'), timestamp '2024-01-31 00:00:00' + interval '1 month 2 days'") == (0.0, 7.0, datetime.datetime(2001, 1, 1), datetime.datetime(2024, 3, 2))
    assert one("'[1,2,3]' <-> '[4,5,6]'") == (pytest.approx(27**0.5),)
    assert one("$$it's$$, E'a\\nb', 'back\\slash', CASE WHEN true THEN 'x' END") == ("it's", "a\nb", "back\\slash", "x")
    assert rows(db.sql("SELECT n FROM generate_series(3, 1, -1) AS g(n)")) == [(3,), (2,), (1,)]
    assert rows(db.sql("SELECT * FROM (VALUES (2), (NULL), (1)) v(x) ORDER BY x DESC")) == [(None,), (2,), (1,)]
    assert sorted(rows(db.sql("""SELECT t.i, e.key, e.value FROM (VALUES (1, '{"a": 1, "b": "x"}')) t(i, j), json_each(t.j) e"""))) == [(1, "a", "1"), (1, "b", '"x"')]
    assert rows(db.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT sum(n) FROM t")) == [(10,)]


def test_rich_types_in_text(db):
    one = lambda q: rows(db.sql("SELECT " + q))[0]
    assert one("int4range(1, 5) @> 4, int4range(1, 5) && int4range(5, 9), '[10,20]'::int4range @> int4range(12, 20), isempty(int4range(3, 3)), upper('[10,20]'::int4range), int4range(1, 5) -|- int4range(5, 9), daterange('2024-01-01', '2024-02-01') @> date '2024-01-15', numrange(1.5, 2.5, '(]') << numrange(3, 4)") == (True, False, True, True, 21, True, True, True)
    assert one("point(1, 2) <-> point(4, 6), box '((0,0),(2,2))' && box(point(1, 1), point(3, 3)), '(0,0),(4,4)'::box @> '(1,1),(2,2)'::box, '(0,0),(1,1)'::box << '(2,2),(3,3)'::box, '(0,0),(1,1)'::box <<| '(2,2),(3,3)'::box") == (5.0, True, True, True, True)
    assert one("to_tsvector('english', 'The quick brown foxes') @@ to_tsquery('english', 'quick & !cats'), to_tsvector('simple', 'a b1 b2') @@ phraseto_tsquery('simple', 'b1 b2'), to_tsvector('quick fox') @@ plainto_tsquery('cat'), ts_rank(to_tsvector('dogs'), to_tsquery('dog & cat'))") == (True, True, False, 0.5)
    assert one("format('%s-%L', 1, 'a'), encode('hi', 'hex'), date_bin('15 minutes', timestamp '2024-01-01 10:07:00', timestamp '2000-01-01 00:00:00'), age(timestamp '2001-04-10 00:00:00', timestamp '1957-06-13 00:00:00')::text = '43 years 9 months 27 days', regexp_count('abcabc', 'b'), array_replace(ARRAY[1, 2], 2, 9), array_positions(ARRAY[1, 2, 1], 1), array_fill(0, ARRAY[2, 2]), 5 << 2, regexp_substr('a1b2', '[0-9]', 1, 2)") == ("1-'a'", "6869", datetime.datetime(2024, 1, 1, 10, 0), True, 2, [1, 9], [1, 3], [[0, 0], [0, 0]], 20, "2")
    assert rows(db.sql("SELECT m[1] FROM (SELECT regexp_matches('a1b2', '[0-9]', 'g') AS m) s ORDER BY 1")) == [("1",), ("2",)]


def test_dml_upsert_returning(emp):
    got = rows(emp.sql("UPDATE employees SET salary = salary * 2, name = upper(name) WHERE department = 'Marketing' RETURNING name, salary"))
    assert sorted(got) == [("GRACE", Decimal("140000.00")), ("HENRY", Decimal("144000.00"))]
    assert rows(emp.sql("DELETE FROM employees WHERE name LIKE 'G%' RETURNING id")) == [(7,)]
    emp.sql("CREATE UNIQUE INDEX u ON employees (name)")
    got = rows(emp.sql("INSERT INTO employees (name, department, salary) VALUES ('Bob', 'Ops', 1), ('Zoe', 'Ops', 2) ON CONFLICT (name) DO UPDATE SET department = excluded.department, salary = employees.salary + excluded.salary RETURNING name, department, salary"))
    assert sorted(got) == [("Bob", "Ops", Decimal("85001.00")), ("Zoe", "Ops", Decimal("2.00"))]
    assert rows(emp.sql("INSERT INTO employees (name, department) VALUES ('Bob', 'X') ON CONFLICT (name) DO NOTHING RETURNING name")) == []
    with pytest.raises(CheckViolation):
        emp.sql("INSERT INTO employees (name) VALUES ('Bob')")
    with pytest.raises(CheckViolation):
        emp.sql("INSERT INTO employees (department) VALUES ('x')")
    with pytest.raises(ValueError):
        emp.sql("INSERT INTO employees (name, department) VALUES ('a')")
    emp.sql("CREATE TABLE raises (dep text, pct int)")
    emp.sql("INSERT INTO raises VALUES ('Eng', 10)")
    emp.sql("UPDATE employees e SET salary = e.salary + r.pct FROM raises r WHERE e.department = r.dep")
    assert rows(emp.sql("SELECT salary FROM employees WHERE name = 'Alice'")) == [(Decimal("90010.00"),)]
    emp.sql("DELETE FROM employees USING raises WHERE employees.department = raises.dep")
    assert rows(emp.sql("SELECT count(*) FROM employees WHERE department = 'Eng'")) == [(0,)]


def test_many_changes_cut_lineage(db):
    db.sql("CREATE TABLE t (n int)")
    for i in range(10):
        db.sql(f"INSERT INTO t VALUES ({i})")
    assert rows(db.sql("SELECT sum(n) FROM t")) == [(45,)]


def test_transactions(db):
    db.script("CREATE TABLE t (n int); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); SAVEPOINT a; INSERT INTO t VALUES (3); ROLLBACK TO SAVEPOINT a")
    assert sorted(rows(db.sql("SELECT n FROM t"))) == [(1,), (2,)]
    with pytest.raises(ValueError):
        db.sql("SELECT 1 FROM missing_function_name_call(1").collect()
    with pytest.raises(TransactionAborted):
        db.sql("SELECT 1")
    db.sql("ROLLBACK")
    assert rows(db.sql("SELECT n FROM t")) == [(1,)]


def test_row_level_security(db):
    db.script("""CREATE TABLE docs (id int, owner text, title text, is_public boolean);
        INSERT INTO docs VALUES (1, 'alice', 'a', false), (2, 'bob', 'b', true), (3, 'carol', 'c', false);
        CREATE ROLE alice LOGIN; CREATE ROLE bob LOGIN; GRANT SELECT, INSERT, UPDATE, DELETE ON docs TO alice; ALTER TABLE docs ENABLE ROW LEVEL SECURITY""")
    assert len(rows(db.sql("SELECT * FROM docs"))) == 3
    db.sql("SET ROLE alice")
    assert rows(db.sql("SELECT id FROM docs")) == []
    db.sql("RESET ROLE")
    db.sql("CREATE POLICY own ON docs USING (owner = current_user)")
    db.sql("CREATE POLICY pub ON docs FOR SELECT USING (is_public)")
    db.sql("CREATE POLICY lim ON docs AS RESTRICTIVE FOR SELECT USING (id < 3)")
    db.sql("SET ROLE alice")
    assert sorted(rows(db.sql("SELECT id FROM docs"))) == [(1,), (2,)]
    assert "owner" in rows(db.sql("EXPLAIN SELECT id FROM docs"))[0][0] or any("owner" in r[0] for r in rows(db.sql("EXPLAIN SELECT id FROM docs")))
    with pytest.raises(PermissionDenied):
        db.sql("INSERT INTO docs VALUES (9, 'bob', 'x', false)")
    db.sql("INSERT INTO docs VALUES (0, 'alice', 'x', false)")
    db.sql("UPDATE docs SET title = 'mine'")
    db.sql("DELETE FROM docs WHERE id = 2")
    db.sql("SET ROLE bob")
    with pytest.raises(PermissionDenied):
        db.sql("SELECT * FROM docs")
    db.sql("RESET ROLE")
    assert sorted(rows(db.sql("SELECT id, title FROM docs"))) == [(0, "mine"), (1, "mine"), (2, "b"), (3, "c")]


def test_roles_inherit(db):
    db.script("CREATE TABLE t (n int); CREATE ROLE readers; CREATE ROLE dave LOGIN; GRANT SELECT ON t TO readers; GRANT readers TO dave; SET ROLE dave")
    assert rows(db.sql("SELECT count(*) FROM t")) == [(0,)]
    with pytest.raises(PermissionDenied):
        db.sql("INSERT INTO t VALUES (1)")
    db.script("RESET ROLE; REVOKE readers FROM dave; SET ROLE dave")
    with pytest.raises(PermissionDenied):
        db.sql("SELECT * FROM t")


@pytest.mark.parametrize("form", ["text", "csv", "binary"])
def test_copy_round_trip(db, tmp_path, form):
    db.sql("CREATE TABLE a (id int, name text, ok boolean, x double precision, d date, n numeric(12,3))")
    db.sql("INSERT INTO a VALUES (1, 'tab\there', true, 1.5, '2020-01-02', 12345.678), (2, NULL, false, NULL, NULL, -0.5), (3, 'quote \" and , back\\slash', NULL, -2, '1999-12-31', 0)")
    db.sql(f"COPY a TO '{tmp_path}/out' WITH (FORMAT {form})")
    db.sql("CREATE TABLE b (id int, name text, ok boolean, x double precision, d date, n numeric(12,3))")
    db.sql(f"COPY b FROM '{tmp_path}/out' WITH (FORMAT {form})")
    assert sorted(rows(db.sql("SELECT * FROM a")), key=str) == sorted(rows(db.sql("SELECT * FROM b")), key=str)


def test_copy_text_header_by_position(db, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.txt").write_text("ID\tNAME\n1\ta\nid\tname\n")
    (tmp_path / "h" / "2.txt").write_text("id\tname\n2\tb\n")
    db.sql("CREATE TABLE h (id text, name text)")
    db.sql(f"COPY h FROM '{tmp_path}/h' WITH (FORMAT text, HEADER)")
    assert sorted(rows(db.sql("SELECT * FROM h"))) == [("1", "a"), ("2", "b"), ("id", "name")]


def test_copy_binary_types(spark, tmp_path):
    import uuid

    from larkspan.sources import copyio
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("u", T.StringType(), True, {"type": "uuid"}), T.StructField("s", T.StringType()), T.StructField("k", T.LongType())])
    data = [(str(uuid.UUID(int=k * 0x1234567890ABCDEF1234567890ABCDE)), "sixteen bytes ok", None if k % 3 == 0 else k) for k in range(1, 40)] + [(None, None, 0)]
    copyio.copy_to_binary(spark.createDataFrame(data, schema).repartition(3), f"{tmp_path}/b")
    assert sorted(map(str, (tuple(r) for r in copyio.copy_from_binary(spark, f"{tmp_path}/b", schema).collect()))) == sorted(map(str, data))
    with pytest.raises(ValueError):
        copyio.copy_to_binary(spark.createDataFrame(data, schema), f"{tmp_path}/b")
    with pytest.raises(ValueError):
        copyio._numeric(bytes.fromhex("00000000C0000000"))


def test_copy_options(db, tmp_path):
    (tmp_path / "x.csv").write_text("id;name\n1;'it''s'\n2;NA\n")
    db.sql("CREATE TABLE c (id int, name text, extra int)")
    db.sql(f"COPY c (id, name) FROM '{tmp_path}/x.csv' WITH (FORMAT csv, DELIMITER ';', QUOTE '''', NULL 'NA', HEADER)")
    assert sorted(rows(db.sql("SELECT * FROM c"))) == [(1, "it's", None), (2, None, None)]
    with pytest.raises(ValueError):
        db.sql(f"COPY c FROM '{tmp_path}/x.csv' WITH (NONSENSE)")


def test_functions_and_scripts(db):
    db.sql("CREATE FUNCTION add2(a int, b int DEFAULT 10) RETURNS int LANGUAGE sql AS $$ SELECT a + $2 $$")
    assert rows(db.sql("SELECT add2(1, 2), add2(5), add2(b := 1, a := 2)")) == [(3, 15, 3)]
    db.sql("CREATE FUNCTION strict_up(s text) RETURNS text AS 'SELECT upper($1) || ''!''' LANGUAGE sql STRICT")
    assert rows(db.sql("SELECT strict_up('a'), strict_up(NULL)")) == [("A!", None)]
    db.sql("CREATE TABLE nums (n int)")
    db.sql("INSERT INTO nums VALUES (1), (2), (3)")
    db.sql("CREATE FUNCTION big(least int) RETURNS TABLE(n int) AS $$ SELECT n FROM nums WHERE n >= least $$ LANGUAGE sql")
    assert sorted(rows(db.sql("SELECT n FROM big(2) b"))) == [(2,), (3,)]
    db.sql("""CREATE FUNCTION grade(x int) RETURNS text AS $$ DECLARE g text := 'F'; BEGIN
        IF x > 90 THEN g := 'A'; ELSIF x > 50 THEN RETURN 'B'; END IF; RETURN g || '.'; END; $$ LANGUAGE plpgsql""")
    assert rows(db.sql("SELECT grade(95), grade(60), grade(n) FROM nums WHERE n = 1")) == [("A.", "B", "F.")]
    db.sql("""CREATE FUNCTION fact(n int) RETURNS bigint AS $$ DECLARE r bigint := 1; BEGIN
        FOR i IN 1..n LOOP r := r * i; END LOOP; RETURN r; END; $$ LANGUAGE plpgsql""")
    assert rows(db.sql("SELECT fact(5)")) == [(120,)]
    db.sql("DO $$ DECLARE k int := 0; BEGIN WHILE k < 2 LOOP k := k + 1; INSERT INTO nums VALUES (100 + k); END LOOP; RAISE NOTICE 'done %', k; END $$")
    assert rows(db.sql("SELECT count(*) FROM nums WHERE n > 100")) == [(2,)] and db.notices == ["done 2"]


def test_triggers(db):
    db.script("""CREATE TABLE users (id int, name text); CREATE TABLE log (id int);
        CREATE FUNCTION fix() RETURNS trigger AS $$ BEGIN IF NEW.name IS NULL THEN RETURN NULL; END IF; NEW.name := upper(NEW.name); RETURN NEW; END; $$ LANGUAGE plpgsql;
        CREATE TRIGGER t BEFORE INSERT ON users FOR EACH ROW EXECUTE FUNCTION fix()""")
    db.add_trigger("audit", "users", "AFTER", "INSERT", lambda new: db._store("log", db.tables["log"].unionByName(new.select("id"))))
    db.sql("INSERT INTO users VALUES (1, 'ann'), (2, NULL)")
    assert rows(db.sql("SELECT * FROM users")) == [(1, "ANN")] and rows(db.sql("SELECT * FROM log")) == [(1,)]


def test_definitions_catalog_and_session(db):
    db.script("""CREATE TYPE mood AS ENUM ('sad', 'ok'); CREATE TABLE p (id int PRIMARY KEY, m mood, s varchar(3), q int DEFAULT 7 CHECK (q > 0));
        CREATE VIEW v(a) AS SELECT id FROM p; COMMENT ON TABLE p IS 'people'""")
    with pytest.raises(CheckViolation):
        db.sql("INSERT INTO p VALUES (1, 'angry')")
    with pytest.raises(CheckViolation):
        db.sql("INSERT INTO p VALUES (1, 'ok', 'long')")
    with pytest.raises(CheckViolation):
        db.sql("INSERT INTO p VALUES (1, 'ok', 'x', -1)")
    db.sql("INSERT INTO p (id, m) VALUES (1, 'ok')")
    assert rows(db.sql("SELECT id, m, q FROM p")) == [(1, "ok", 7)] and rows(db.sql("SELECT a FROM v")) == [(1,)]
    assert ("p",) in rows(db.sql("SELECT tablename FROM pg_tables"))
    assert ("id", "integer", "NO") in rows(db.sql("SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = 'p'"))
    db.sql("CREATE TABLE c AS SELECT 1 AS x UNION ALL SELECT 2")
    db.sql("ALTER TABLE c ADD COLUMN y int DEFAULT 5")
    assert sorted(rows(db.sql("SELECT * FROM c"))) == [(1, 5), (2, 5)]
    db.script("PREPARE q AS SELECT x FROM c WHERE x > $1; SET work_mem = '4MB'")
    assert rows(db.sql("EXECUTE q(1)")) == [(2,)] and rows(db.sql("SHOW work_mem")) == [("4MB",)]
    assert rows(db.sql("SELECT x FROM c WHERE x = $1", 2)) == [(2,)]
    assert rows(db.sql("SELECT current_user, current_schema(), current_setting('work_mem')")) == [("postgres", "public", "4MB")]
    db.script("TRUNCATE c; DROP TABLE c; DROP TABLE IF EXISTS c")
    with pytest.raises(ValueError):
        db.sql("DROP TABLE c")


def test_lexer():
    assert [t.text for t in lex("a->>'x''y' -- c\n<= $1 /* z */ ::int")] == ["a", "->>", "x'y", "<=", "$1", "::", "int"]
    assert split_statements("SELECT ';'; ; SELECT $$;$$") == ["SELECT ';'", "SELECT $$;$$"]
    assert to_spark('SELECT "A b" FROM t FETCH FIRST 3 ROWS ONLY') == "SELECT `A b` FROM t LIMIT 3"


def test_materialized_views_hold_their_rows(db):
    db.script("CREATE TABLE base (x int); INSERT INTO base VALUES (1), (2); CREATE MATERIALIZED VIEW held (y) AS SELECT x * 10 FROM base; CREATE MATERIALIZED VIEW later AS SELECT x FROM base WITH NO DATA")
    db.sql("INSERT INTO base VALUES (3)")
    assert rows(db.sql("SELECT y FROM held ORDER BY y")) == [(10,), (20,)]
    with pytest.raises(ValueError, match="not been populated"):
        db.sql("SELECT x FROM later")
    db.script("REFRESH MATERIALIZED VIEW CONCURRENTLY held; REFRESH MATERIALIZED VIEW later WITH DATA")
    assert rows(db.sql("SELECT y FROM held ORDER BY y")) == [(10,), (20,), (30,)] and rows(db.sql("SELECT count(*) FROM later")) == [(3,)]
    db.script("BEGIN; DELETE FROM base; REFRESH MATERIALIZED VIEW held; ROLLBACK")
    assert rows(db.sql("SELECT count(*) FROM held")) == [(3,)]
    with pytest.raises(ValueError, match="not a materialized view"):
        db.sql("REFRESH MATERIALIZED VIEW base")
    db.sql("DROP MATERIALIZED VIEW held")
    with pytest.raises(Exception, match="cannot be found"):
        db.sql("SELECT y FROM held")


def test_interval_with_unit_and_frame_offset(db):
    db.script("CREATE TABLE at (t timestamp); INSERT INTO at VALUES ('2024-01-01'), ('2024-01-02 12:00:00'), ('2024-01-05')")
    assert rows(db.sql("SELECT count(*) OVER (ORDER BY t RANGE BETWEEN INTERVAL '2' DAY PRECEDING AND CURRENT ROW) AS n FROM at ORDER BY t")) == [(1,), (2,), (1,)]
    with pytest.raises(ValueError, match="months are not supported"):
        db.sql("SELECT count(*) OVER (ORDER BY t RANGE BETWEEN INTERVAL '1 month' PRECEDING AND CURRENT ROW) FROM at")
