"""Roles, grants and row-level security, applied where a table name is resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PermissionDenied(Exception):
    """SQLSTATE 42501."""


@dataclass
class Role:
    name: str
    superuser: bool = False
    bypass_rls: bool = False
    login: bool = False
    member_of: set[str] = field(default_factory=set)


@dataclass
class Policy:
    """A row policy: command is ALL, SELECT, INSERT, UPDATE or DELETE; texts are Spark SQL predicates."""

    name: str
    table: str
    using: str | None = None
    check: str | None = None
    command: str = "ALL"
    roles: tuple[str, ...] = ("public",)
    permissive: bool = True


class Authority:
    """Roles, table grants and policies of one catalog."""

    def __init__(self):
        self.roles = {"postgres": Role("postgres", superuser=True, login=True)}
        self.grants: dict[tuple[str, str], set[str]] = {}
        self.default_grants: dict[str, set[str]] = {}
        self.owners: dict[str, str] = {}
        self.enabled: set[str] = set()
        self.forced: set[str] = set()
        self.policies: list[Policy] = []
        self.settings: dict[str, str] = {}

    def create_role(self, name: str, **options) -> None:
        if name in self.roles:
            raise ValueError(f'role "{name}" already exists')
        self.roles[name] = Role(name, **options)

    def drop_role(self, name: str) -> None:
        if any(o == name for o in self.owners.values()):
            raise ValueError(f'role "{name}" cannot be dropped because some objects depend on it')
        self._role(name)
        del self.roles[name]
        self.grants = {k: v for k, v in self.grants.items() if k[0] != name}
        for r in self.roles.values():
            r.member_of.discard(name)

    def _role(self, name: str) -> Role:
        if name not in self.roles:
            raise ValueError(f'role "{name}" does not exist')
        return self.roles[name]

    def all_roles(self, name: str) -> set[str]:
        """The role, all roles that it is a member of, and public."""
        found, todo = {"public"}, [name]
        while todo:
            r = todo.pop()
            if r not in found:
                found.add(r)
                todo += self._role(r).member_of
        return found

    def grant(self, privileges: set[str], table: str, role: str) -> None:
        if role != "public":
            self._role(role)
        self.grants.setdefault((role, table), set()).update(p.upper() for p in privileges)

    def revoke(self, privileges: set[str], table: str, role: str) -> None:
        held = self.grants.get((role, table), set())
        self.grants[role, table] = set() if "ALL" in privileges else held - {p.upper() for p in privileges} - ({"ALL"} if privileges else set())

    def grant_role(self, granted: str, member: str) -> None:
        if member in self.all_roles(granted):
            raise ValueError(f'role "{granted}" is a member of role "{member}"')
        self._role(member).member_of.add(granted)

    def revoke_role(self, granted: str, member: str) -> None:
        self._role(member).member_of.discard(granted)

    def own(self, table: str, role: str) -> None:
        self.owners[table] = role
        for r, p in self.default_grants.items():
            self.grant(p, table, r)

    def drop_table(self, table: str) -> None:
        self.owners.pop(table, None)
        self.grants = {k: v for k, v in self.grants.items() if k[1] != table}
        self.policies = [p for p in self.policies if p.table != table]
        self.enabled.discard(table)
        self.forced.discard(table)

    def check(self, role: str, table: str, privilege: str) -> None:
        """Raise unless the role may do this; superusers and owners may do all."""
        roles = self.all_roles(role)
        if self._role(role).superuser or self.owners.get(table) in roles:
            return
        if not any({privilege, "ALL"} & self.grants.get((r, table), set()) for r in roles):
            raise PermissionDenied(f"permission denied for table {table}")

    def predicate(self, role: str, table: str, command: str = "SELECT", check: bool = False) -> str | None:
        """The policies' condition, None if no policy holds: (any permissive) AND (all restrictive); FALSE without a permissive one."""
        if table not in self.enabled:
            return None
        roles, r = self.all_roles(role), self._role(role)
        if r.superuser or r.bypass_rls or (self.owners.get(table) in roles and table not in self.forced):
            return None
        mine = [p for p in self.policies if p.table == table and p.command in ("ALL", command) and roles & set(p.roles)]
        text = lambda p: (p.check or p.using or "true") if check else (p.using or "true")
        allow = [text(p) for p in mine if p.permissive]
        limit = [text(p) for p in mine if not p.permissive]
        if not allow:
            return "false"
        out = " AND ".join(f"({x})" for x in [" OR ".join(f"({a})" for a in allow), *limit])
        quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        out = out.replace("current_role_name()", quoted(role))
        return re.sub(r"current_setting_of\('([^']*)'\)", lambda m: quoted(self.settings.get(m[1].lower(), "")), out)

    def visible(self, df: DataFrame, role: str, table: str, command: str = "SELECT") -> DataFrame:
        """The rows that the role sees; the condition is an ordinary filter, so it is pushed down to the scan."""
        p = self.predicate(role, table, command)
        return df if p is None else df.filter(F.expr(p))

    def require_checked(self, rows: DataFrame, role: str, table: str, command: str) -> DataFrame:
        """The rows with a test that raises, when they are read, for one that WITH CHECK forbids."""
        p = self.predicate(role, table, command, check=True)
        if p is None:
            return rows
        if rows.filter(~F.coalesce(F.expr(p), F.lit(False))).limit(1).count():
            raise PermissionDenied(f'new row violates row-level security policy for table "{table}"')
        return rows
