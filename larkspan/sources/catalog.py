"""pg_catalog and information_schema as DataFrames over an engine's registry."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

#: Spark types and their catalog names and oids.
TYPE_OIDS = {"boolean": ("bool", 16), "binary": ("bytea", 17), "bigint": ("int8", 20), "smallint": ("int2", 21), "int": ("int4", 23), "string": ("text", 25), "float": ("float4", 700), "double": ("float8", 701), "date": ("date", 1082), "timestamp_ntz": ("timestamp", 1114), "timestamp": ("timestamptz", 1184)}
#: Canonical names as format_type() shows them.
FORMATTED = {"bool": "boolean", "int8": "bigint", "int2": "smallint", "int4": "integer", "float4": "real", "float8": "double precision", "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone"}


def type_of(spark_type: str) -> tuple[str, int]:
    """Catalog name and oid of a Spark type."""
    if spark_type.startswith("decimal"):
        return "numeric", 1700
    if spark_type.startswith("array<"):
        name, oid = type_of(spark_type[6:-1])
        return f"_{name}", 1000 + oid
    return TYPE_OIDS.get(spark_type, ("text", 25))


def oid_of(name: str) -> int:
    """A stable object id from 16384 on."""
    return 16384 + zlib.crc32(name.encode()) % (1 << 30)


def view(engine, name: str) -> DataFrame | None:
    """The catalog view of that name, or None."""
    make = _VIEWS.get(name.removeprefix("pg_catalog.").removeprefix("information_schema."))
    if make is None:
        return None
    schema, rows = make(engine)
    return engine.spark.createDataFrame(rows, schema)


def known(name: str) -> bool:
    """Is there a catalog view of that name?"""
    return name in _VIEWS


def _relations(e):
    return [(n, "r") for n in sorted(e.tables)] + [(n, "v") for n in sorted(e.views)]


def _columns(e):
    for name, _ in _relations(e):
        for i, (c, t) in enumerate(e.resolve(name, check=False).dtypes, 1):
            yield name, i, c, t


_VIEWS = {
    "pg_namespace": lambda e: ("oid long, nspname string", [(oid_of(s), s) for s in sorted({"pg_catalog", "public", "information_schema", *e.schemas})]),
    "pg_class": lambda e: ("oid long, relname string, relkind string, relnamespace long, relowner long, relrowsecurity boolean", [(oid_of(n), n, k, oid_of("public"), oid_of(e.authority.owners.get(n, "postgres")), n in e.authority.enabled) for n, k in _relations(e)]),
    "pg_attribute": lambda e: ("attrelid long, attname string, attnum int, atttypid long, attnotnull boolean", [(oid_of(n), c, i, type_of(t)[1], c in e.not_null.get(n, ())) for n, i, c, t in _columns(e)]),
    "pg_type": lambda e: ("oid long, typname string, typtype string", [(o, n, "b") for n, o in TYPE_OIDS.values()] + [(1700, "numeric", "b")] + [(oid_of(n), n, "e") for n in sorted(e.enums)]),
    "pg_enum": lambda e: ("enumtypid long, enumlabel string, enumsortorder double", [(oid_of(n), x, float(i)) for n in sorted(e.enums) for i, x in enumerate(e.enums[n], 1)]),
    "pg_tables": lambda e: ("schemaname string, tablename string, tableowner string, rowsecurity boolean", [("public", n, e.authority.owners.get(n, "postgres"), n in e.authority.enabled) for n in sorted(e.tables)]),
    "pg_views": lambda e: ("schemaname string, viewname string, definition string", [("public", n, d) for n, d in sorted(e.views.items())]),
    "pg_indexes": lambda e: ("schemaname string, tablename string, indexname string", [("public", t, i) for i, t in sorted(e.indexes.items())]),
    "pg_roles": lambda e: ("oid long, rolname string, rolsuper boolean, rolcanlogin boolean, rolbypassrls boolean", [(oid_of(r.name), r.name, r.superuser, r.login, r.bypass_rls) for r in e.authority.roles.values()]),
    "pg_auth_members": lambda e: ("roleid long, member long", [(oid_of(m), oid_of(r.name)) for r in e.authority.roles.values() for m in sorted(r.member_of)]),
    "pg_settings": lambda e: ("name string, setting string", sorted(e.settings.items())),
    "pg_proc": lambda e: ("oid long, proname string, pronargs int, prolang string", [(oid_of(n), n, len(f.params), f.language) for n, f in sorted(e.functions.items())]),
    "pg_trigger": lambda e: ("oid long, tgrelid long, tgname string", [(oid_of(t.name), oid_of(t.table), t.name) for t in e.triggers]),
    "pg_policies": lambda e: ("tablename string, policyname string, permissive string, cmd string, qual string, with_check string", [(p.table, p.name, "PERMISSIVE" if p.permissive else "RESTRICTIVE", p.command, p.using, p.check) for p in e.authority.policies]),
    "pg_description": lambda e: ("objoid long, description string", [(oid_of(n), d) for n, d in sorted(e.comments.items())]),
    "pg_database": lambda e: ("oid long, datname string", [(oid_of("larkspan"), "larkspan")]),
    "pg_extension": lambda e: ("oid long, extname string", [(oid_of("plpgsql"), "plpgsql")]),
    "tables": lambda e: ("table_schema string, table_name string, table_type string", [("public", n, "BASE TABLE" if k == "r" else "VIEW") for n, k in _relations(e)]),
    "columns": lambda e: ("table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string", [("public", n, c, i, FORMATTED.get(type_of(t)[0], type_of(t)[0]), "NO" if c in e.not_null.get(n, ()) else "YES") for n, i, c, t in _columns(e)]),
}
