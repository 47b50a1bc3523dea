"""SQL functions as macros, and a PL/pgSQL subset whose scalar bodies become one expression or run as a script."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from larkspan.plans.dialect import Token, closing, lex, show, split_list, split_statements, text_of


@dataclass
class Function:
    """A user function; `params` are names (or '') of its IN parameters."""

    name: str
    params: list[str]
    returns: str
    body: str
    language: str = "sql"
    strict: bool = False
    table: bool = False
    defaults: list[str | None] = field(default_factory=list)


def parse_function(tokens: list[Token]) -> Function:
    """CREATE [OR REPLACE] FUNCTION name(params) RETURNS type ... AS 'body' LANGUAGE x."""
    i = next(k for k, t in enumerate(tokens) if t.low == "function") + 1
    name = tokens[i].text.lower()
    j = closing(tokens, i + 1)
    params, defaults = [], []
    for p in split_list(tokens[i + 2 : j]):
        words = [t for t in p if t.low not in ("in", "inout", "variadic")]
        if p and p[0].low == "out":
            continue
        cut = next((k for k, t in enumerate(words) if t.low == "default" or t.text == "="), None)
        defaults.append(text_of(words[cut + 1 :]) if cut is not None else None)
        words = words[:cut] if cut is not None else words
        params.append(words[0].text.lower() if len(words) > 1 else "")
    rest = tokens[j + 1 :]
    at = lambda w: next((k for k, t in enumerate(rest) if t.low == w), None)
    r, a, lang = at("returns"), at("as"), at("language")
    stop = min(k for k in (a, lang, len(rest)) if k is not None and (r is None or k > r))
    returns = " ".join(t.text.lower() for t in rest[r + 1 : stop]) if r is not None else "void"
    body = rest[a + 1].text if a is not None else ""
    return Function(name, params, returns, body, rest[lang + 1].text.lower() if lang is not None else "sql", at("strict") is not None or at("returns") is not None and "null" in [t.low for t in rest[at("returns") + 1 :]] and "input" in [t.low for t in rest], returns.startswith(("setof", "table")), defaults)


def bind_arguments(fn: Function, args: list[str]) -> list[str]:
    """Positional and named (a := 1, a => 1) arguments in parameter order, with defaults."""
    out: dict[int, str] = {}
    for k, a in enumerate(args):
        m = re.match(r"(\w+)\s*(?::=|=\s*>)\s*(.*)", a, re.S)
        if m and m[1].lower() in fn.params:
            out[fn.params.index(m[1].lower())] = m[2]
        else:
            out[k] = a
    full = [out.get(k, fn.defaults[k] if k < len(fn.defaults) else None) for k in range(len(fn.params))]
    if None in full or len(out) > len(fn.params):
        raise ValueError(f"function {fn.name} does not exist for {len(args)} arguments")
    return full


def substitute(text: str, names: list[str], values: list[str]) -> str:
    """$n and parameter names replaced by bracketed values."""
    out = []
    tokens = lex(text)
    for k, t in enumerate(tokens):
        dotted = k and tokens[k - 1].text == "."
        if t.kind == "param":
            out.append(Token("raw", f"({values[int(t.text[1:]) - 1]})"))
        elif t.kind == "name" and t.low in names and not dotted:
            out.append(Token("raw", f"({values[names.index(t.low)]})"))
        else:
            out.append(t)
    return text_of(out)


def expand(fn: Function, args: list[str], rewrite) -> str:
    """A call as an expression (or sub-query): Catalyst sees through it."""
    values = bind_arguments(fn, args)
    if fn.language == "plpgsql":
        body = expression_of(fn.body, fn.params, values)
        out = rewrite(body)
    else:
        body = substitute(split_statements(fn.body)[-1], fn.params, values)
        tokens = lex(body)
        simple = tokens[0].low == "select" and not any(t.low in ("from", "where", "union", "group", "order", "limit") for t in tokens)
        out = rewrite(text_of(tokens[1:])) if simple and not fn.table else f"({rewrite(body)})"
    if fn.strict and not fn.table:
        return f"CASE WHEN {' OR '.join(f'({v}) IS NULL' for v in values)} THEN NULL ELSE {out} END" if values else out
    return out


class NotAnExpression(ValueError):
    """A body that loops, queries or assigns under conditions in a way that one expression can't hold."""


def _block(text: str) -> tuple[list[tuple[str, str]], str]:
    """Declared (name, initial value) pairs and the statements of a body."""
    m = re.match(r"\s*(?:declare(.*?))?begin(.*)end\s*;?\s*$", text, re.I | re.S)
    if not m:
        raise ValueError("syntax error in a PL/pgSQL body")
    declared = []
    for d in split_statements(m[1] or ""):
        n, _, v = re.sub(r"(?i)\bdefault\b", ":=", d).partition(":=")
        declared.append((n.split()[0].lower(), v.strip() or "NULL"))
    return declared, m[2]


def statements(text: str) -> list:
    """A tree of statements: ('if', [(test, body)...], else), ('while', test, body), ('for', var, lo, hi, body), or ('do', text)."""
    tokens, out, i = lex(text), [], 0

    def until(k, stops):
        depth, begin = 0, k
        while k < len(tokens):
            low = tokens[k].low
            if not depth and low in stops:
                return k
            if low in ("if", "loop", "case") and not (k and tokens[k - 1].low == "end"):
                depth += 1
            if low == "end":
                depth -= 1
            k += 1
        raise ValueError(f"syntax error: {stops} expected after {text_of(tokens[begin : begin + 5])}")

    while i < len(tokens):
        low = tokens[i].low
        if low == "if":
            arms, other = [], []
            k = i
            while tokens[k].low in ("if", "elsif", "elseif"):
                j = until(k + 1, ("then",))
                e = until(j + 1, ("elsif", "elseif", "else", "end"))
                arms.append((text_of(tokens[k + 1 : j]), statements(text_of(tokens[j + 1 : e]))))
                k = e
            if tokens[k].low == "else":
                e = until(k + 1, ("end",))
                other, k = statements(text_of(tokens[k + 1 : e])), e
            out.append(("if", arms, other))
            i = k + 3
        elif low == "while":
            j = until(i + 1, ("loop",))
            e = until(j + 1, ("end",))
            out.append(("while", text_of(tokens[i + 1 : j]), statements(text_of(tokens[j + 1 : e]))))
            i = e + 3
        elif low == "for":
            j = until(i + 1, ("loop",))
            e = until(j + 1, ("end",))
            head = tokens[i + 3 : j]
            cut = next((k for k in range(len(head) - 1) if head[k].text == "." and head[k + 1].text == "."), None)
            num = next((k for k, t in enumerate(head) if t.kind == "num" and t.text.endswith(".")), None)
            if cut is None and num is None:
                raise NotAnExpression("only integer FOR loops are run")
            lo, hi = (text_of(head[:cut]), text_of(head[cut + 2 :])) if cut is not None else (text_of([*head[:num], Token("num", head[num].text[:-1])]), text_of(head[num + 2 :] if head[num + 1].text == "." else [Token("num", head[num + 1].text[1:]), *head[num + 2 :]]))
            out.append(("for", tokens[i + 1].low, lo, hi, statements(text_of(tokens[j + 1 : e]))))
            i = e + 3
        else:
            j = next((k for k in range(i, len(tokens)) if tokens[k].text == ";" and tokens[k].kind == "op"), len(tokens))
            if j > i:
                out.append(("do", text_of(tokens[i:j])))
            i = j + 1
    return out


def expression_of(body: str, names: list[str], values: list[str]) -> str:
    """A body of assignments, IFs and RETURNs as one CASE expression."""
    declared, text = _block(body)
    env = dict(zip(names, values))
    for n, v in declared:
        env[n] = substitute(v, list(env), list(env.values()))

    def run(todo: list, env: dict) -> str:
        if not todo:
            return "NULL"
        head, rest = todo[0], todo[1:]
        inside = lambda s: substitute(s, list(env), list(env.values()))
        if head[0] == "if":
            arms = "".join(f" WHEN {inside(t)} THEN {run(b + rest, dict(env))}" for t, b in head[1])
            return f"CASE{arms} ELSE {run(head[2] + rest, dict(env))} END"
        if head[0] != "do":
            raise NotAnExpression("loops are run as scripts")
        m = re.match(r"(?is)return\b(.*)", head[1])
        if m:
            return f"({inside(m[1].strip() or 'NULL')})"
        m = re.match(r"(?is)(\w+)\s*(?::=|=)(?!=)(.*)", head[1])
        if m and m[1].lower() in env:
            return run(rest, env | {m[1].lower(): inside(m[2])})
        m = re.match(r"(?is)raise\s+exception\s+(.*)", head[1])
        if m:
            return f"raise_error({split_list_text(m[1])})"
        if re.match(r"(?is)(null|raise\b.*|perform\b.*)$", head[1]):
            return run(rest, env)
        raise NotAnExpression(head[1])

    return run(statements(text), env)


def split_list_text(s: str) -> str:
    """RAISE's format and arguments as an expression."""
    parts = split_list(lex(s))
    out, rest = [], [text_of(p) for p in parts[1:]]
    for piece in re.split("(%)", parts[0][0].text):
        out.append(f"CAST({rest.pop(0)} AS STRING)" if piece == "%" and rest else show(Token("str", piece)))
    return f"concat({', '.join(out)})"


class Return(Exception):
    def __init__(self, value):
        self.value = value


class Script:
    """Runs a body on the driver, statement by statement; values are literals of one-row queries."""

    def __init__(self, engine, most_steps: int = 100_000):
        self.engine, self.left = engine, most_steps

    def call(self, body: str, names: list[str] = (), values: list = ()):
        declared, text = _block(body)
        env = dict(zip(names, values))
        for n, v in declared:
            env[n] = self.value(v, env)
        try:
            self.run(statements(text), env)
        except Return as r:
            return r.value
        return None

    def literal(self, v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else show(Token("str", str(v)))

    def text(self, s: str, env: dict) -> str:
        return substitute(s, list(env), [self.literal(v) for v in env.values()])

    def value(self, s: str, env: dict):
        if re.fullmatch(r"\s*-?\d+\s*", s):
            return int(s)
        row = self.engine.sql(f"SELECT {self.text(s, env)} AS v").first()
        return row["v"] if row else None

    def run(self, todo: list, env: dict) -> None:
        for s in todo:
            self.left -= 1
            if self.left < 0:
                raise RuntimeError("a script ran too long")
            if s[0] == "if":
                for test, body in s[1]:
                    if self.value(test, env):
                        self.run(body, env)
                        break
                else:
                    self.run(s[2], env)
            elif s[0] == "while":
                try:
                    while self.value(s[1], env):
                        self.run(s[2], env)
                except StopIteration:
                    pass
            elif s[0] == "for":
                try:
                    for i in range(self.value(s[2], env), self.value(s[3], env) + 1):
                        env[s[1]] = i
                        self.run(s[4], env)
                except StopIteration:
                    pass
            else:
                self.one(s[1], env)

    def one(self, s: str, env: dict) -> None:
        if m := re.match(r"(?is)return\b(.*)", s):
            raise Return(self.value(m[1], env) if m[1].strip() else None)
        if m := re.match(r"(?is)exit(?:\s+when\s+(.*))?$", s):
            if not m[1] or self.value(m[1], env):
                raise StopIteration
            return
        if m := re.match(r"(?is)(\w+)\s*(?::=|=)(?!=)(.*)", s):
            if m[1].lower() in env:
                env[m[1].lower()] = self.value(m[2], env)
                return
        if m := re.match(r"(?is)raise\s+(exception|notice|warning|info)\s+(.*)", s):
            message = self.value(split_list_text(m[2]), env)
            if m[1].lower() == "exception":
                raise RuntimeError(message)
            self.engine.notices.append(message)
            return
        if m := re.match(r"(?is)select\s+(.*?)\s+into\s+(\w+)\s*(.*)", s):
            row = self.engine.sql(self.text(f"SELECT {m[1]} {m[3]}", env)).first()
            env[m[2].lower()] = row[0] if row else None
            env["found"] = row is not None
            return
        if m := re.match(r"(?is)perform\s+(.*)", s):
            self.engine.sql(self.text(f"SELECT {m[1]}", env)).first()
            return
        if m := re.match(r"(?is)execute\s+(.*)", s):
            self.engine.sql(self.value(m[1], env))
            return
        if s.lower().strip() != "null":
            self.engine.sql(self.text(s, env))
