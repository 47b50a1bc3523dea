"""A PostgreSQL-flavoured session over Spark: statements in, DataFrames out.

Tables are DataFrames under a name. A query's text is rewritten to Spark SQL
and, while it is analysed, the tables that it names stand as temporary views,
filtered by row policies; Catalyst does the rest. Data changes build a new DataFrame
for the table; every few changes its lineage is cut by a checkpoint.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.operators import dml
from larkspan.plans import procedures
from larkspan.plans.dialect import Rewriter, Token, closing, lex, show, spark_type, split_list, split_statements, text_of
from larkspan.plans.policy import Authority, PermissionDenied, Policy
from larkspan.sources import catalog, copyio


class TransactionAborted(Exception):
    """SQLSTATE 25P02."""


class CheckViolation(ValueError):
    """SQLSTATE 23502, 23505, 23514: a row breaks a constraint."""


@dataclass
class Trigger:
    """Row trigger: fn(frame of NEW or OLD rows) gives the rows that go on (BEFORE), or is told of them (AFTER)."""

    name: str
    table: str
    timing: str
    event: str
    fn: object


#: Changes to a table after which its lineage is cut.
CUT_AFTER = 8


class Engine:
    def __init__(self, spark: SparkSession, role: str = "postgres", authority: Authority | None = None):
        self.spark = spark
        self.authority, self.role, self.session_role = authority or Authority(), role, role
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.stored: dict[str, DataFrame | None] = {}  # rows of materialized views; None before the first REFRESH
        self.schemas = {"public"}
        self.not_null: dict[str, tuple[str, ...]] = {}
        self.checks: dict[str, list[str]] = {}
        self.unique: dict[str, list[list[str]]] = {}
        self.defaults: dict[str, dict[str, str]] = {}
        self.enums: dict[str, list[str]] = {}
        self.enum_columns: dict[str, dict[str, str]] = {}
        self.indexes: dict[str, str] = {}
        self.comments: dict[str, str] = {}
        self.functions: dict[str, procedures.Function] = {}
        self.triggers: list[Trigger] = []
        self.prepared: dict[str, str] = {}
        self.settings = {"search_path": '"$user", public', "timezone": "UTC", "client_encoding": "UTF8", "datestyle": "ISO, MDY", "standard_conforming_strings": "on", "server_version": "17.0"}
        self.authority.settings = self.settings
        self.notices: list[str] = []
        self._changes: dict[str, int] = {}
        self._saved: list[tuple[str | None, dict]] = []
        self._failed = False

    # ---- names -------------------------------------------------------------

    def add_table(self, name: str, df: DataFrame, owner: str | None = None) -> None:
        """Put a DataFrame under a name."""
        self.tables[name.lower()] = df
        self.authority.own(name.lower(), owner or self.role)

    def add_trigger(self, name: str, table: str, timing: str, event: str, fn) -> None:
        self.triggers.append(Trigger(name, table.lower(), timing.upper(), event.upper(), fn))

    def _plain(self, name: str) -> str:
        name = name.lower().replace("`", "").replace('"', "")
        head, _, last = name.rpartition(".")
        return last if head in ("", "public") or head in self.schemas and last in self.tables else name

    def resolve(self, name: str, privilege: str = "SELECT", check: bool = True) -> DataFrame:
        """A table as the current role sees it."""
        name = self._plain(name)
        if name in self.tables:
            if check:
                self.authority.check(self.role, name, privilege)
                return self.authority.visible(self.tables[name], self.role, name, privilege)
            return self.tables[name]
        if name in self.stored:
            if self.stored[name] is None:
                raise ValueError(f'materialized view "{name}" has not been populated')
            return self.stored[name]
        if name in self.views:
            return self.query(self.views[name])
        found = catalog.view(self, name)
        if found is not None:
            return found
        raise ValueError(f'relation "{name}" does not exist')

    # ---- statements --------------------------------------------------------

    def script(self, text: str) -> list[DataFrame | None]:
        """All statements of a text."""
        return [self.sql(s) for s in split_statements(text)]

    def sql(self, text: str, *params) -> DataFrame | None:
        """Run one statement; queries and RETURNING give a DataFrame. $1, $2 ... are `params`."""
        text = text.strip().rstrip(";")
        if params:
            script = procedures.Script(self)
            text = text_of_source([Token("raw", script.literal(params[int(t.text[1:]) - 1])) if t.kind == "param" else t for t in lex(text)])
        tokens = lex(text)
        if not tokens:
            return None
        words = [t.low for t in tokens[:4]] + [""] * 4
        if self._failed and words[0] not in ("rollback", "abort", "commit", "end"):
            raise TransactionAborted("current transaction is aborted, commands ignored until end of transaction block")
        try:
            return self._dispatch(text, tokens, words)
        except Exception:
            self._failed = bool(self._saved)
            raise

    def _dispatch(self, text: str, tokens: list[Token], words: list[str]) -> DataFrame | None:
        head = words[0]
        if head in ("select", "values", "with", "table") or tokens[0].text == "(":
            return self.query(f"SELECT * FROM {tokens[1].text}" if head == "table" else text)
        special = {
            "insert": self._insert, "update": self._update, "delete": self._delete, "create": self._create, "drop": self._drop, "truncate": self._truncate, "alter": self._alter,
            "grant": self._grant, "revoke": self._revoke, "set": self._set, "reset": self._reset, "show": self._show, "copy": self._copy, "explain": self._explain,
            "begin": self._begin, "start": self._begin, "commit": self._commit, "end": self._commit, "rollback": self._rollback, "abort": self._rollback, "savepoint": self._savepoint, "release": self._release,
            "prepare": self._prepare, "execute": self._execute, "deallocate": self._deallocate, "comment": self._comment, "do": self._do, "refresh": self._refresh,
        }
        if head in ("vacuum", "analyze", "reindex", "cluster", "discard", "listen", "notify", "lock"):
            return None
        if head not in special:
            raise ValueError(f'syntax error at or near "{tokens[0].text}"')
        return special[head](tokens)

    def _macros(self) -> dict:
        again = lambda s: text_of(self._rewriter().rewrite(lex(s)))
        calls = {n: (lambda *a, f=f: procedures.expand(f, list(a), again)) for n, f in self.functions.items() if f.language == "sql" or self._is_expression(f)}
        fixed = {
            "current_setting": lambda n, *m: show(Token("str", self.settings.get(n.strip("'").lower(), ""))),
            "current_schema": lambda: "'public'", "current_database": lambda: "'larkspan'", "pg_get_userbyid": lambda o: "'postgres'", "pg_table_is_visible": lambda o: "true",
            "pg_input_is_valid": lambda s, k: f"(try_cast({s} AS {spark_type(lex(k.strip(chr(39))))[0]}) IS NOT NULL)",
            "format_type": lambda o, m: f"CAST({o} AS STRING)", "obj_description": lambda *a: "NULL", "has_table_privilege": lambda *a: self._has_privilege(a),
        }
        return fixed | calls

    def _has_privilege(self, a) -> str:
        who, table, privilege = (a if len(a) == 3 else (f"'{self.role}'", *a))
        try:
            self.authority.check(who.strip("'"), table.strip("'"), privilege.strip("'").upper())
        except PermissionDenied:
            return "false"
        return "true"

    @staticmethod
    def _is_expression(f: procedures.Function) -> bool:
        try:
            procedures.expression_of(f.body, f.params, ["NULL"] * len(f.params))
        except (procedures.NotAnExpression, ValueError):
            return False
        return True

    def _rewriter(self) -> Rewriter:
        who = {"current_user": self.role, "current_role": self.role, "user": self.role, "session_user": self.session_role}
        return Rewriter(who, self._macros())

    def spark_sql(self, text: str) -> str:
        """Spark SQL of a query."""
        return text_of(self._rewriter().rewrite(lex(text)))

    def query(self, text: str) -> DataFrame:
        """A query over the visible rows; output names are lower-cased unless quoted."""
        tokens = lex(text)
        call = tokens[1:] if tokens[0].low == "select" else []
        if len(call) >= 3 and call[0].low in self.functions and call[1].text == "(" and closing(call, 1) == len(call) - 1 and self.functions[call[0].low].language == "plpgsql" and not self._is_expression(self.functions[call[0].low]):
            f = self.functions[call[0].low]
            values = [self.query(f"SELECT {text_of_source(a)} AS v").first()["v"] for a in split_list(call[2:-1])]
            kind = spark_type(lex(f.returns))[0] if f.returns != "void" else "string"
            got = procedures.Script(self).call(f.body, f.params, values)
            return self.spark.createDataFrame([(got,)], f"{f.name} string").select(F.col(f.name).cast(kind)) if got is None or kind == "string" else self.spark.createDataFrame([(got,)], [f.name]).select(F.col(f.name).cast(kind).alias(f.name))
        tokens = self._unqualified(tokens)
        bound = self._bind(tokens)
        try:
            return self.spark.sql(text_of(self._rewriter().rewrite(tokens)))
        finally:
            for name in bound:
                self.spark.catalog.dropTempView(name)

    def _unqualified(self, tokens: list[Token]) -> list[Token]:
        """Without schema names; views of information_schema get a name of their own."""
        out, i = [], 0
        while i < len(tokens):
            low = tokens[i].text.lower() if tokens[i].kind in ("name", "quoted") else ""
            if low in ("pg_catalog", "information_schema", *self.schemas) and i + 2 < len(tokens) and tokens[i + 1].text == "." and not (out and out[-1].text == "."):
                name = tokens[i + 2]
                out.append(Token("name", f"__is_{name.low}") if low == "information_schema" else name)
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _bind(self, tokens: list[Token]) -> set[str]:
        """Views for the relations that the text may name; gives their names."""
        bound: dict[str, DataFrame] = {}
        defined = {tokens[i].low for i in range(len(tokens) - 2) if tokens[i + 1].low == "as" and tokens[i + 2].text == "(" or tokens[i + 1].text == "(" and i and tokens[i - 1].low in ("with", "recursive")}
        for i, t in enumerate(tokens):
            name = t.text.lower() if t.kind in ("name", "quoted") else ""
            if not name or name in defined:
                continue
            source = i and (tokens[i - 1].low in ("from", "join", "lateral", "only", "using", "table") or tokens[i - 1].text in (",", "("))
            if source and name.startswith("__is_"):
                bound[name] = catalog.view(self, name[5:])
            elif source and (name in self.tables or name in self.views or name.startswith("pg_") and catalog.known(name)):
                bound[name] = self.resolve(name)
        for name, df in bound.items():  # after all are resolved: a view's text binds names of its own
            df.createOrReplaceTempView(name)
        found = set(bound)
        for f in self.functions.values():
            inner = lex(f.body) if f.language == "sql" else []
            if inner and any(t.low == f.name for t in tokens):
                found |= self._bind(inner)
        return found

    # ---- data changes ------------------------------------------------------

    def _store(self, name: str, df: DataFrame) -> None:
        self._changes[name] = self._changes.get(name, 0) + 1
        if self._changes[name] % CUT_AFTER == 0:
            df = self._written(df)
        self.tables[name] = df

    def _written(self, df: DataFrame) -> DataFrame:
        """The rows as they are now, in the cluster's shared folder."""
        sc = self.spark.sparkContext
        if not sc.getCheckpointDir():
            import tempfile

            folder = sc.getConf().get("spark.checkpoint.dir")
            if not folder and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkspan-"))
        return df.checkpoint()

    def _fire(self, name: str, timing: str, event: str, rows: DataFrame) -> DataFrame:
        for t in self.triggers:
            if t.table == name and t.timing == timing and t.event == event:
                out = t.fn(rows)
                rows = out if timing == "BEFORE" and out is not None else rows
        return rows

    def _validate(self, name: str, rows: DataFrame, table: DataFrame) -> None:
        """NOT NULL, CHECK, enum labels and UNIQUE of the new rows."""
        bad = [(F.col(c).isNull(), f'null value in column "{c}" of relation "{name}" violates not-null constraint') for c in self.not_null.get(name, ())]
        bad += [(~F.coalesce(F.expr(self.spark_sql(x)), F.lit(True)), f'new row for relation "{name}" violates check constraint ({x})') for x in self.checks.get(name, [])]
        bad += [(~F.col(c).isin(*self.enums[e]), f'invalid input value for enum {e} in column "{c}"') for c, e in self.enum_columns.get(name, {}).items()]
        if bad:
            found = rows.agg(*[F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False)).alias(f"b{i}") for i, (test, _) in enumerate(bad)]).first()
            for hit, (_, message) in zip(found, bad):
                if hit:
                    raise CheckViolation(message)
        for keys in self.unique.get(name, []):
            full = table.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
            if full.limit(1).count():
                raise CheckViolation(f"duplicate key value violates unique constraint on ({', '.join(keys)})")

    def _returning(self, tokens: list[Token] | None, affected: DataFrame, name: str) -> DataFrame | None:
        if tokens is None:
            return None
        affected.createOrReplaceTempView("__affected")
        return self.spark.sql(f"SELECT {text_of(self._rewriter().rewrite(tokens))} FROM __affected AS {name}")

    def _clauses(self, tokens: list[Token], *words: str) -> dict[str, list[Token]]:
        """Token runs after each top-level keyword, `head` before the first."""
        out, key, depth = {"head": []}, "head", 0
        for t in tokens:
            depth += t.kind == "op" and t.text == "("
            depth -= t.kind == "op" and t.text == ")"
            if not depth and t.low in words and t.low not in out:
                key = t.low
                out[key] = []
            else:
                out[key].append(t)
        return out

    def _expr(self, tokens: list[Token]):
        return F.expr(text_of(self._rewriter().rewrite(tokens)))

    def _insert(self, tokens: list[Token]) -> DataFrame | None:
        name, i = self._plain(tokens[2].text), 3
        while tokens[i].text == ".":
            name, i = self._plain(tokens[i + 1].text), i + 2
        self.authority.check(self.role, name, "INSERT")
        table = self.tables[name]
        columns = None
        if tokens[i].text == "(" and tokens[i + 1].low != "select":
            j = closing(tokens, i)
            columns, i = [t.text.lower() for t in tokens[i + 1 : j] if t.text != ","], j + 1
        part = self._clauses(tokens[i:], "returning")
        body = part["head"]
        cut = next((k for k in range(len(body) - 1) if body[k].low == "on" and body[k + 1].low == "conflict"), None)
        conflict = body[cut + 2 :] if cut is not None else None
        body = body[:cut] if cut is not None else body
        defaults = self.defaults.get(name, {})
        if [t.low for t in body[:2]] == ["default", "values"]:
            given = self.spark.range(1).select(*[F.expr(defaults.get(c, "NULL")).alias(c) for c in table.columns])
            columns = table.columns
        elif body[0].low == "values":
            listed = split_list(body[1:])
            names = columns or table.columns[: len(split_list(listed[0][1:-1]))]
            rows = []
            for r in listed:
                cells = split_list(r[1:-1])
                if len(cells) != len(names):
                    raise ValueError("INSERT has more expressions than target columns" if len(cells) > len(names) else "INSERT has more target columns than expressions")
                rows.append("(" + ", ".join((defaults.get(names[k], "NULL") if len(c) == 1 and c[0].low == "default" else text_of(self._rewriter().rewrite(c))) for k, c in enumerate(cells)) + ")")
            given = self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}")
        else:
            given = self.query(text_of_source(body))
        full = dml.insert(table, given, columns).affected
        given_columns = columns or table.columns[: len(given.columns)]
        for c, d in defaults.items():
            if c not in given_columns:
                full = full.withColumn(c, F.expr(d).cast(dict(table.dtypes)[c]))
        full = self._fire(name, "BEFORE", "INSERT", full)
        self.authority.require_checked(full, self.role, name, "INSERT")
        if conflict is None:
            change = dml.Change(table.unionByName(full), full)
        else:
            j = closing(conflict, 0) if conflict[0].text == "(" else -1
            keys = [t.text.lower() for t in conflict[1:j] if t.text != ","] or (self.unique.get(name) or [[table.columns[0]]])[0]
            action = self._clauses(conflict[j + 1 :], "set", "where")
            assign = None
            if "set" in action:
                self.authority.check(self.role, name, "UPDATE")
                assign = {c: self._qualified(v, table.columns, name) for c, v in self._assignments(action["set"]).items()}
            where = self._qualified(action["where"], table.columns, name) if "where" in action else None
            change = dml.upsert(table, full, keys, assign, where)
        self._validate(name, change.affected, change.table)
        self._store(name, change.table)
        self._fire(name, "AFTER", "INSERT", change.affected)
        return self._returning(part.get("returning"), change.affected, name)

    def _assignments(self, tokens: list[Token]) -> dict[str, list[Token]]:
        out = {}
        for a in split_list(tokens):
            cut = next(k for k, t in enumerate(a) if t.text == "=")
            if a[0].text == "(":
                values = a[cut + 1 :]
                values = values[1:] if values[0].low == "row" else values
                out |= dict(zip([t.text.lower() for t in a[1 : cut - 1] if t.text != ","], split_list(values[1:-1])))
            else:
                out[a[cut - 1].text.lower()] = a[cut + 1 :]
        return out

    def _qualified(self, tokens: list[Token], columns: list[str], name: str):
        """An expression in which bare columns and those of the table mean t, and excluded stays."""
        out = []
        for k, t in enumerate(tokens):
            dotted = k and tokens[k - 1].text == "."
            if t.low == name and k + 1 < len(tokens) and tokens[k + 1].text == ".":
                out.append(Token("name", "t"))
            elif t.kind in ("name", "quoted") and t.text.lower() in columns and not dotted and not (k + 1 < len(tokens) and tokens[k + 1].text == "("):
                out += [Token("name", "t"), Token("op", "."), t]
            else:
                out.append(t)
        return self._expr(out)

    def _target(self, tokens: list[Token]) -> tuple[str, str]:
        """Table and alias of UPDATE t [AS] a or DELETE FROM t [AS] a."""
        names = [t for t in tokens if t.low not in ("as", "only") and t.text != "."]
        if len(tokens) > 1 and tokens[1].text == ".":
            names = names[1:]
        return self._plain(names[0].text), (names[1] if len(names) > 1 else names[0]).text.lower()

    def _update(self, tokens: list[Token]) -> DataFrame | None:
        part = self._clauses(tokens[1:], "set", "from", "where", "returning")
        name, alias = self._target(part["head"])
        self.authority.check(self.role, name, "UPDATE")
        table = self.tables[name]
        seen = self.authority.predicate(self.role, name, "UPDATE")
        assign = self._assignments(part["set"])
        strip = lambda ts: [t for k, t in enumerate(ts) if not (t.low in (alias, name) and k + 1 < len(ts) and ts[k + 1].text == "." or t.text == "." and k and ts[k - 1].low in (alias, name))]
        if "from" in part:
            other = self.query(f"SELECT * FROM {text_of_source(part['from'])}")
            other_alias = next((t.low for t in reversed(part["from"]) if t.kind == "name"), "o")
            rename = lambda ts: [Token("name", "t") if t.low in (alias, name) and k + 1 < len(ts) and ts[k + 1].text == "." else Token("name", "o") if t.low == other_alias and k + 1 < len(ts) and ts[k + 1].text == "." else t for k, t in enumerate(ts)]
            on = self._expr(rename(part.get("where", [Token("name", "true")])))
            change = dml.update_from(table, other, on if seen is None else on & F.expr(seen), {c: self._expr(rename(v)) for c, v in assign.items()}, (self.unique.get(name) or [table.columns])[0])
        else:
            where = self._condition(strip(part["where"])) if "where" in part else None
            if seen is not None:
                where = F.expr(seen) if where is None else where & F.expr(seen)
            change = dml.update(table, {c: self._expr(strip(v)) for c, v in assign.items()}, where)
        self.authority.require_checked(change.affected, self.role, name, "UPDATE")
        self._fire(name, "BEFORE", "UPDATE", change.affected)
        self._validate(name, change.affected, change.table)
        self._store(name, change.table)
        self._fire(name, "AFTER", "UPDATE", change.affected)
        return self._returning(part.get("returning"), change.affected, name)

    def _condition(self, tokens: list[Token]):
        """A WHERE condition; one with a sub-query is evaluated as a semi join over a scan of the table."""
        if any(t.low == "select" for t in tokens):
            self._bind(tokens)
        return self._expr(tokens)

    def _delete(self, tokens: list[Token]) -> DataFrame | None:
        part = self._clauses(tokens[2:], "using", "where", "returning")
        name, alias = self._target(part["head"])
        self.authority.check(self.role, name, "DELETE")
        table = self.tables[name]
        seen = self.authority.predicate(self.role, name, "DELETE")
        if "using" in part:
            other = self.query(f"SELECT * FROM {text_of_source(part['using'])}")
            other_alias = next((t.low for t in reversed(part["using"]) if t.kind == "name"), "o")
            rename = [Token("name", "t") if t.low in (alias, name) else Token("name", "o") if t.low == other_alias else t for t in part["where"]]
            change = dml.delete_using(table, other, self._expr(rename))
        else:
            ts = part.get("where")
            ts = ts and [t for k, t in enumerate(ts) if not (t.low in (alias, name) and k + 1 < len(ts) and ts[k + 1].text == "." or t.text == "." and k and ts[k - 1].low in (alias, name))]
            where = self._condition(ts) if ts else None
            if seen is not None:
                where = F.expr(seen) if where is None else where & F.expr(seen)
            change = dml.delete(table, where)
        self._fire(name, "BEFORE", "DELETE", change.affected)
        self._store(name, change.table)
        self._fire(name, "AFTER", "DELETE", change.affected)
        return self._returning(part.get("returning"), change.affected, name)

    def _truncate(self, tokens: list[Token]) -> None:
        for t in tokens[1:]:
            name = self._plain(t.text)
            if t.kind in ("name", "quoted") and name in self.tables:
                self.authority.check(self.role, name, "TRUNCATE")
                self._store(name, self.tables[name].limit(0))

    # ---- definitions -------------------------------------------------------

    def _create(self, tokens: list[Token]) -> None:
        words = [t.low for t in tokens]
        rest = [w for w in words[1:6] if w not in ("or", "replace", "temp", "temporary", "unlogged", "materialized", "unique", "recursive")]
        kind = rest[0]
        at = words.index(kind) + 1
        exists_ok = words[at : at + 3] == ["if", "not", "exists"]
        at += 3 * exists_ok
        if kind == "function":
            f = procedures.parse_function(tokens)
            self.functions[f.name] = f
            return None
        name = self._plain(tokens[at].text) if kind not in ("policy", "role", "user", "trigger", "type", "schema", "index") else tokens[at].text.lower()
        while at + 1 < len(tokens) and tokens[at + 1].text == ".":
            at += 2
            name = self._plain(tokens[at].text)
        if kind == "table":
            if name in self.tables:
                if exists_ok:
                    return None
                raise ValueError(f'relation "{name}" already exists')
            if tokens[at + 1].low == "as" or tokens[at + 1].text == "(" and (j := closing(tokens, at + 1)) + 1 < len(tokens) and tokens[j + 1].low == "as":
                k = next(k for k in range(at, len(tokens)) if tokens[k].low == "as")
                df = self.query(text_of_source(tokens[k + 1 :]))
                self.add_table(name, df.toDF(*[t.text.lower() for t in tokens[at + 2 : k - 1] if t.text != ","]) if tokens[at + 1].text == "(" else df)
                return None
            return self._create_table(name, split_list(tokens[at + 2 : closing(tokens, at + 1)]))
        if kind == "view":
            k = next(k for k in range(at, len(tokens)) if tokens[k].low == "as" and not _inside(tokens, k))
            stored, body = "materialized" in words[:at], tokens[k + 1 :]
            if exists_ok and name in self.views:
                return None
            empty = stored and [t.low for t in body[-3:]] == ["with", "no", "data"]
            if stored and body[-1].low == "data":
                body = body[: -3 if empty else -2]
            text = text_of_source(body)
            if k > at + 1 and tokens[at + 1].text == "(":
                text = f"SELECT * FROM ({text}) AS v({', '.join(t.text for t in tokens[at + 2 : k - 1] if t.text != ',')})"
            self.stored.pop(name, None)
            rows = self._written(self.query(text)) if stored and not empty else None
            self.views[name] = text
            if stored:
                self.stored[name] = rows
            return None
        if kind == "schema":
            self.schemas.add(name)
        elif kind == "index":
            table = tokens[words.index("on") + 1].text.lower()
            self.indexes[name] = table
            if "unique" in words and "where" not in words:
                i = words.index("on") + 2
                self.unique.setdefault(table, []).append([t.text.lower() for t in tokens[i + 1 : closing(tokens, i)] if t.text != ","])
        elif kind == "type":
            if "enum" in words:
                i = words.index("enum") + 1
                self.enums[name] = [t.text for t in tokens[i + 1 : closing(tokens, i)] if t.kind == "str"]
        elif kind in ("role", "user"):
            self.authority.create_role(name, superuser="superuser" in words, bypass_rls="bypassrls" in words, login="login" in words or kind == "user")
        elif kind == "policy":
            part = self._clauses(tokens[at + 1 :], "on", "as", "for", "to", "using", "with")
            rls = lambda k: text_of(self._policy_tokens(part[k][1:-1] if k == "using" else part[k][2:-1])) if k in part else None
            table = self._plain(part["on"][0].text)
            self.authority.policies.append(Policy(name, table, rls("using"), rls("with"), part["for"][0].text.upper() if "for" in part else "ALL", tuple(t.text.lower() for t in part["to"] if t.text != ",") if "to" in part else ("public",), "as" not in part or part["as"][0].low != "restrictive"))
        elif kind == "trigger":
            table = tokens[words.index("on") + 1].text.lower()
            fn = next(t.low for t in tokens[words.index("execute") + 1 :] if t.low not in ("function", "procedure", ""))
            timing = "BEFORE" if "before" in words else "AFTER"
            for event in ("insert", "update", "delete"):
                if event in words[: words.index("on")]:
                    self.add_trigger(name, table, timing, event, self._row_function(fn, event))
        elif kind not in ("extension", "sequence", "domain", "aggregate", "cast", "operator", "rule"):
            raise ValueError(f'CREATE {kind.upper()} is not supported')
        return None

    def _policy_tokens(self, tokens: list[Token]) -> list[Token]:
        """A policy text whose user names are looked up when it is used."""
        return [t if t.low not in ("current_user", "session_user", "current_role") else Token("raw", "current_role_name()") for t in Rewriter({}, {"current_setting": lambda n, *m: f"current_setting_of({n})"}).rewrite(tokens)]

    def _row_function(self, fn: str, event: str):
        """A trigger function of assignments to NEW, IFs and RETURN NEW / NULL / OLD as a projection of the rows."""

        def run(rows: DataFrame) -> DataFrame:
            f = self.functions[fn]
            declared, body = procedures._block(f.body)
            env = {c: f"`{c}`" for c in rows.columns}

            def walk(todo, env, guard):
                for k, s in enumerate(todo):
                    if s[0] == "if":
                        outs = []
                        for test, inner in s[1]:
                            outs.append((self._new(test, env), walk(inner + todo[k + 1 :], dict(env), guard)))
                        other = walk(s[2] + todo[k + 1 :], dict(env), guard)
                        cases = lambda pick: "CASE " + " ".join(f"WHEN {t} THEN {pick(o)}" for t, o in outs) + f" ELSE {pick(other)} END"
                        return {c: cases(lambda o, c=c: o[0][c]) for c in env}, cases(lambda o: o[1])
                    text = s[1]
                    if m := re.match(r"(?is)new\s*\.\s*(\w+)\s*(?::=|=)(.*)", text):
                        env[m[1].lower()] = f"({self._new(m[2], env)})"
                    elif m := re.match(r"(?is)return\s+(new|old|null)", text):
                        return env, "false" if m[1].lower() == "null" else "true"
                    elif m := re.match(r"(?is)raise\s+exception\s+(.*)", text):
                        return env, f"raise_error({self._new(procedures.split_list_text(m[1]), env)})"
                return env, "true"

            env, keep = walk(procedures.statements(body), env, "true")
            kinds = dict(rows.dtypes)
            return rows.withColumn("_keep", F.expr(keep).cast("boolean")).filter("_keep").select(*[F.expr(env[c]).cast(kinds[c]).alias(c) for c in rows.columns])

        return run

    def _new(self, text: str, env: dict) -> str:
        tokens, out, k = lex(text), [], 0
        while k < len(tokens):
            if tokens[k].low in ("new", "old") and k + 2 < len(tokens) and tokens[k + 1].text == ".":
                out.append(Token("raw", f"({env[tokens[k + 2].low]})"))
                k += 3
            else:
                out.append(tokens[k])
                k += 1
        return text_of(self._rewriter().rewrite(out))

    def _create_table(self, name: str, items: list[list[Token]]) -> None:
        fields, needed, checks, unique, defaults, enums = [], [], [], [], {}, {}
        for item in items:
            words = [t.low for t in item]
            if words[0] in ("primary", "unique", "check", "foreign", "constraint"):
                k = 2 if words[0] == "constraint" else 0
                inner = item[k:]
                i = next(i for i, t in enumerate(inner) if t.text == "(")
                j = closing(inner, i)
                if inner[0].low == "check":
                    checks.append(text_of_source(inner[i + 1 : j]))
                elif inner[0].low in ("primary", "unique"):
                    unique.append([t.text.lower() for t in inner[i + 1 : j] if t.text != ","])
                    needed += unique[-1] if inner[0].low == "primary" else []
                continue
            column = item[0].text.lower()
            kind, n = spark_type(item[1:])
            if item[1].text.lower() in self.enums:
                kind, n, enums[column] = "string", 1, item[1].text.lower()
            fields.append(f"`{column}` {kind}")
            after = item[1 + n :]
            low = [t.low for t in after]
            if "not" in low and low[low.index("not") + 1] == "null" or "primary" in low or item[1].low.endswith("serial"):
                needed.append(column)
            if "primary" in low or "unique" in low:
                unique.append([column])
            if "default" in low:
                k = low.index("default") + 1
                stop = next((x for x in range(k, len(after)) if low[x] in ("not", "null", "unique", "primary", "check", "references")), len(after))
                defaults[column] = text_of(self._rewriter().rewrite(after[k : max(stop, k + 1)]))
            if item[1].low.endswith("serial"):
                defaults[column] = f"(SELECT coalesce(max({column}), 0) FROM __none)"
            if "check" in low:
                k = low.index("check") + 1
                checks.append(text_of_source(after[k + 1 : closing(after, k)]))
            m = re.fullmatch(r"(varchar|char|character)", item[1].low)
            if m and n >= 4 and item[2].text == "(":
                checks.append(f"length({column}) <= {item[3].text}")
        serial = [c for c, d in defaults.items() if "__none" in d]
        for c in serial:
            del defaults[c]
        self.add_table(name, self.spark.createDataFrame([], ", ".join(fields)))
        self.not_null[name] = tuple(c for c in needed if c not in serial)
        self.checks[name], self.unique[name], self.defaults[name], self.enum_columns[name] = checks, unique, defaults, enums
        for c in serial:  # numbered when rows come in: after the largest number so far, in the rows' order
            self.add_trigger(f"{name}_{c}_seq", name, "BEFORE", "INSERT", lambda rows, c=c: self._number(name, c, rows))

    def _number(self, name: str, column: str, rows: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        start = self.tables[name].agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]
        w = Window.partitionBy(F.col(column).isNull()).orderBy(F.monotonically_increasing_id())
        kind = dict(rows.dtypes)[column]
        return rows.withColumn(column, F.coalesce(F.col(column), (F.row_number().over(w) + start).cast(kind)))

    def _drop(self, tokens: list[Token]) -> None:
        words = [t.low for t in tokens]
        kind = next(w for w in words[1:] if w != "materialized")
        soft = "if" in words
        names = [t.text.lower() for t in tokens[words.index(kind) + 1 :] if t.kind in ("name", "quoted") and t.low not in ("if", "exists", "cascade", "restrict", "concurrently")]
        for name in names[:1] if kind in ("policy", "trigger", "function") else names:
            name = self._plain(name) if kind in ("table", "view") else name
            if kind == "policy":
                self.authority.policies = [p for p in self.authority.policies if p.name != name]
                continue
            if kind == "trigger":
                self.triggers = [t for t in self.triggers if t.name != name]
                continue
            if kind in ("role", "user"):
                self.authority.drop_role(name)
                continue
            place = {"table": self.tables, "view": self.views, "function": self.functions, "index": self.indexes, "type": self.enums}.get(kind)
            if kind == "schema":
                self.schemas.discard(name)
            elif place is not None:
                if name not in place and not soft:
                    raise ValueError(f'{kind} "{name}" does not exist')
                if kind == "table" and name in place:
                    self.authority.drop_table(name)
                place.pop(name, None)
                if kind == "view":
                    self.stored.pop(name, None)

    def _refresh(self, tokens: list[Token]) -> None:
        """REFRESH MATERIALIZED VIEW [CONCURRENTLY] name [WITH [NO] DATA]: its query runs again."""
        words = [t.low for t in tokens]
        tail = words[-3:] == ["with", "no", "data"]
        names = tokens[4 if "concurrently" in words[3:4] else 3 :]
        names = names[: next((i for i, t in enumerate(names) if t.low == "with"), len(names))]
        name = self._plain("".join(t.text for t in names))
        if words[1:3] != ["materialized", "view"] or name not in self.stored:
            raise ValueError(f'"{name}" is not a materialized view')
        self.stored[name] = None if tail else self._written(self.query(self.views[name]))

    def _alter(self, tokens: list[Token]) -> None:
        words = [t.low for t in tokens]
        if words[1] in ("role", "user"):
            r = self.authority._role(tokens[2].text.lower())
            r.superuser = ("superuser" in words or r.superuser) and "nosuperuser" not in words
            r.bypass_rls = ("bypassrls" in words or r.bypass_rls) and "nobypassrls" not in words
            return
        if words[1:3] == ["default", "privileges"]:
            i = words.index("grant")
            role = tokens[words.index("to") + 1].text.lower()
            self.authority.default_grants.setdefault(role, set()).update(t.text.upper() for t in tokens[i + 1 : words.index("on")] if t.kind == "name")
            return
        if words[1] != "table":
            return
        name = self._plain(next(t.text for t in tokens[2:] if t.low not in ("if", "exists", "only")))
        joined = " ".join(words)
        table = self.tables[name]
        if "row level security" in joined:
            place = self.authority.forced if "force" in words else self.authority.enabled
            place.discard(name) if "disable" in words or "no" in words else place.add(name)
        elif "owner to" in joined:
            self.authority.owners[name] = tokens[-1].text.lower()
        elif "add constraint" in joined or "add check" in joined or "add unique" in joined or "add primary" in joined:
            item = tokens[words.index("add") + 1 :]
            item = item[2:] if item[0].low == "constraint" else item
            i = next(i for i, t in enumerate(item) if t.text == "(")
            inner = item[i + 1 : closing(item, i)]
            if item[0].low == "check":
                self.checks.setdefault(name, []).append(text_of_source(inner))
            elif item[0].low in ("unique", "primary"):
                self.unique.setdefault(name, []).append([t.text.lower() for t in inner if t.text != ","])
            self._validate(name, table, table)
        elif "add" in words:
            item = [t for t in tokens[words.index("add") + 1 :] if t.low not in ("column",)]
            kind = spark_type(item[1:])[0]
            d = [t.low for t in item]
            value = self._expr(item[d.index("default") + 1 :]) if "default" in d else F.lit(None)
            self._store(name, table.withColumn(item[0].text.lower(), value.cast(kind)))
        elif "rename" in words:
            to = words.index("to")
            if "column" in words or to - words.index("rename") > 1:
                self._store(name, table.withColumnRenamed(tokens[to - 1].text.lower(), tokens[to + 1].text.lower()))
            else:
                new = tokens[to + 1].text.lower()
                self.tables[new] = self.tables.pop(name)
                self.authority.owners[new] = self.authority.owners.pop(name, self.role)
        elif "drop" in words:
            self._store(name, table.drop(tokens[-1].text.lower() if tokens[-1].low not in ("cascade", "restrict") else tokens[-2].text.lower()))

    def _grant(self, tokens: list[Token], revoke: bool = False) -> None:
        words = [t.low for t in tokens]
        to = words.index("from" if revoke else "to")
        roles = [t.text.lower() for t in tokens[to + 1 :] if t.kind in ("name", "quoted") and t.low not in ("with", "grant", "admin", "option", "cascade")]
        if "on" not in words:
            for granted in (t.text.lower() for t in tokens[1:to] if t.kind in ("name", "quoted")):
                for r in roles:
                    (self.authority.revoke_role if revoke else self.authority.grant_role)(granted, r)
            return
        on = words.index("on")
        what = {t.text.upper() for t in tokens[1:on] if t.kind == "name"} - {"PRIVILEGES"}
        targets = [self._plain(t.text) for t in tokens[on + 1 : to] if t.kind in ("name", "quoted") and t.low not in ("table", "schema", "function", "all", "tables", "in")]
        if "tables" in words[on:to]:
            targets = list(self.tables)
        for t in targets:
            for r in roles:
                (self.authority.revoke if revoke else self.authority.grant)(what, t, r)

    def _revoke(self, tokens: list[Token]) -> None:
        self._grant(tokens, revoke=True)

    def _comment(self, tokens: list[Token]) -> None:
        cut = max(k for k, t in enumerate(tokens) if t.low == "is")
        self.comments["".join(t.text for t in tokens[3:cut]).lower()] = tokens[-1].text

    # ---- session -----------------------------------------------------------

    def _set(self, tokens: list[Token]) -> None:
        body = [t for t in tokens[1:] if t.low not in ("session", "local")]
        if body[0].low in ("role", "authorization"):
            name = body[-1].text.lower()
            self.role = self.session_role if name in ("none", "default") else self.authority._role(name).name
            return
        name, rest = body[0].text.lower(), body[1:]
        if name == "time" and rest[0].low == "zone":
            name, rest = "timezone", [Token("op", "="), rest[1]]
        value = "".join(t.text if t.text != "," else ", " for t in rest[1:])
        self.settings[name] = value
        if name == "timezone":
            self.spark.conf.set("spark.sql.session.timeZone", value)

    def _reset(self, tokens: list[Token]) -> None:
        if tokens[1].low == "role":
            self.role = self.session_role
        else:
            self.settings.pop(tokens[1].text.lower(), None)

    def _show(self, tokens: list[Token]) -> DataFrame:
        name = "timezone" if tokens[1].low == "time" else tokens[1].text.lower()
        if name == "all":
            return self.spark.createDataFrame(sorted(self.settings.items()), "name string, setting string")
        if name not in self.settings:
            raise ValueError(f'unrecognized configuration parameter "{name}"')
        return self.spark.createDataFrame([(self.settings[name],)], f"`{name}` string")

    def _explain(self, tokens: list[Token]) -> DataFrame:
        body = [t for t in tokens[1:] if t.low not in ("analyze", "verbose")]
        if body[0].text == "(":
            body = body[closing(body, 0) + 1 :]
        plan = self.query(text_of_source(body))._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(x,) for x in plan.split("\n")], "`query plan` string")

    def _prepare(self, tokens: list[Token]) -> None:
        cut = next(k for k, t in enumerate(tokens) if t.low == "as")
        self.prepared[tokens[1].text.lower()] = text_of_source(tokens[cut + 1 :])

    def _execute(self, tokens: list[Token]) -> DataFrame | None:
        values = [self.query(f"SELECT {text_of_source(a)} AS v").first()["v"] for a in split_list(tokens[3:-1])]
        return self.sql(self.prepared[tokens[1].text.lower()], *values)

    def _deallocate(self, tokens: list[Token]) -> None:
        self.prepared.pop(tokens[-1].text.lower(), None)

    def _do(self, tokens: list[Token]) -> None:
        procedures.Script(self).call(next(t.text for t in tokens if t.kind == "str"))

    def _copy(self, tokens: list[Token]) -> None:
        words = [t.low for t in tokens]
        i = closing(tokens, 1) + 1 if tokens[1].text == "(" else 2
        columns = None
        if tokens[1].text != "(" and tokens[i].text == "(":
            j = closing(tokens, i)
            columns, i = [t.text.lower() for t in tokens[i + 1 : j] if t.text != ","], j + 1
        path = tokens[i + 1].text
        options = {"form": "text"}
        rest = [t for t in tokens[i + 2 :] if t.low != "with" and t.text not in ("(", ")", ",")]
        k = 0
        while k < len(rest):
            w = rest[k].low
            if w in ("csv", "binary", "text"):
                options["form"] = w
            elif w == "format":
                k += 1
                options["form"] = rest[k].text.lower()
            elif w == "header":
                follows = rest[k + 1].low if k + 1 < len(rest) else ""
                options["header"] = follows not in ("false", "off")
                k += follows in ("true", "false", "on", "off")
            elif w in ("delimiter", "null", "quote", "escape", "encoding"):
                k += 1 + (rest[k + 1].low == "as")
                options[w] = rest[k].text
            else:
                raise ValueError(f'COPY option "{rest[k].text}" not recognized')
            k += 1
        if tokens[i].low == "to":
            df = self.query(text_of_source(tokens[2 : i - 1])) if tokens[1].text == "(" else self.resolve(tokens[1].text)
            copyio.copy_to(df.select(*columns) if columns else df, path, **options)
            return None
        name = self._plain(tokens[1].text)
        self.authority.check(self.role, name, "INSERT")
        rows = copyio.copy_from(self.spark, path, T.StructType(self.tables[name].schema.fields), columns=columns, **options)
        rows = self._fire(name, "BEFORE", "INSERT", rows)
        self.authority.require_checked(rows, self.role, name, "INSERT")
        change = dml.insert(self.tables[name], rows)
        self._validate(name, change.affected, change.table)
        self._store(name, change.table)
        return None

    # ---- transactions: DataFrames are immutable, so a snapshot is a copy of the names ----

    def _state(self) -> dict:
        return {k: dict(getattr(self, k)) for k in ("tables", "views", "stored", "functions", "not_null", "checks", "unique", "defaults", "indexes")}

    def _begin(self, tokens: list[Token]) -> None:
        if not self._saved:
            self._saved.append((None, self._state()))

    def _commit(self, tokens: list[Token]) -> None:
        if self._failed:
            return self._rollback(tokens)
        self._saved.clear()
        return None

    def _restore(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, dict(v))

    def _rollback(self, tokens: list[Token]) -> None:
        self._failed = False
        if any(t.low == "to" for t in tokens):
            name = tokens[-1].text.lower()
            i = max((k for k, (n, _) in enumerate(self._saved) if n == name), default=None)
            if i is None:
                raise ValueError(f'savepoint "{name}" does not exist')
            del self._saved[i + 1 :]
            self._restore(self._saved[i][1])
        elif self._saved:
            self._restore(self._saved[0][1])
            self._saved.clear()

    def _savepoint(self, tokens: list[Token]) -> None:
        if not self._saved:
            raise ValueError("SAVEPOINT can only be used in transaction blocks")
        self._saved.append((tokens[1].text.lower(), self._state()))

    def _release(self, tokens: list[Token]) -> None:
        name = tokens[-1].text.lower()
        i = max(k for k, (n, _) in enumerate(self._saved) if n == name)
        del self._saved[i:]


def _inside(tokens: list[Token], k: int) -> bool:
    return sum((t.text == "(") - (t.text == ")") for t in tokens[:k] if t.kind == "op") > 0


def text_of_source(tokens: list[Token]) -> str:
    """Tokens as PostgreSQL text again, so that they can be lexed once more."""
    out = []
    for t in tokens:
        if t.kind == "str":
            out.append("E'" + t.text.replace("\\", "\\\\").replace("'", "''") + "'" if "\\" in t.text else "'" + t.text.replace("'", "''") + "'")
        elif t.kind == "quoted":
            out.append('"' + t.text.replace('"', '""') + '"')
        else:
            out.append(t.text)
    return " ".join(out).replace(" . ", ".")
