"""PostgreSQL query text to Spark SQL text.

A lexer, and rewrites over its tokens: literals, casts and type names, array
syntax, operators without a Spark spelling, function names and arguments with
other semantics, null ordering, DISTINCT ON. Everything else is Spark SQL
already and Catalyst parses it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from larkspan.plans import macros


#: Units that may stand after an interval literal.
UNITS = ("year", "month", "day", "hour", "minute", "second")


class Token(NamedTuple):
    """kind: str, name, quoted, num, param, op, or raw (finished Spark text)."""

    kind: str
    text: str

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "name" else self.text if self.kind == "op" else ""


_LEX = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
    |(?P<estr>[eE]'(?:[^'\\]|\\.|'')*')
    |(?P<str>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<param>\$\d+)
    |(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<name>[A-Za-z_][A-Za-z0-9_$]*)
    |(?P<op>::|:=|->>|\#>>|->|\#>|\#-|@>|<@|@@|<->|<=>|<\#>|<\+>|&&|&<|&>|-\|-|<<\||\|>>|<<|>>|!~~\*|!~~|~~\*|~~|!~\*|!~|~\*|\|\||<=|>=|<>|!=|\?\||\?&|.)""",
    re.X | re.S,
)


def lex(text: str) -> list[Token]:
    """Tokens without space and comments; strings hold their value."""
    out = []
    for m in _LEX.finditer(text):
        kind, s = m.lastgroup, m.group()
        if m.group("space") is not None:
            continue
        if m.group("dollar") is not None:
            n = len(m.group("tag")) + 2
            out.append(Token("str", s[n:-n]))
        elif kind == "estr":
            body = s[2:-1].replace("''", "'")
            out.append(Token("str", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(x[1], x[1]), body)))
        elif kind == "str":
            out.append(Token("str", s[1:-1].replace("''", "'")))
        elif kind == "quoted":
            out.append(Token("quoted", s[1:-1].replace('""', '"')))
        else:
            out.append(Token(kind, s))
    return out


def show(t: Token) -> str:
    """Spark spelling of a token."""
    if t.kind == "str":
        return "'" + t.text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if t.kind == "quoted":
        return "`" + t.text.replace("`", "``") + "`"
    return t.text


def text_of(tokens: list[Token]) -> str:
    """Tokens as Spark SQL."""
    out = ""
    for i, t in enumerate(tokens):
        s = show(t)
        tight = i and (s in (".", ",", ")", "[", "]", "::") or tokens[i - 1].text in (".", "(", "[", "::") and tokens[i - 1].kind == "op" or s == "(" and tokens[i - 1].kind == "name" and tokens[i - 1].low not in _KEYWORDS)
        out += s if tight or not i else " " + s
    return out


def split_statements(text: str) -> list[str]:
    """Statements of a script, at semicolons outside literals."""
    out, begin = [], 0
    for m in _LEX.finditer(text):
        if m.lastgroup == "op" and m.group() == ";":
            out.append(text[begin : m.start()])
            begin = m.end()
    out.append(text[begin:])
    return [s.strip() for s in out if lex(s)]


_KEYWORDS = set("select from where and or not in on using as by having when then else case end values limit offset union all intersect except distinct between like ilike is over partition order group with exists any some filter within join left right full inner cross lateral".split())
# Type names and their Spark counterparts.
TYPES = {
    "int2": "smallint", "smallint": "smallint", "int": "int", "int4": "int", "integer": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "smallserial": "smallint",
    "real": "float", "float4": "float", "float8": "double", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "text": "string", "varchar": "string", "character": "string",
    "char": "string", "bpchar": "string", "name": "string", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "json": "string", "jsonb": "string", "uuid": "string",
    "inet": "string", "cidr": "string", "macaddr": "string", "xml": "string", "money": "decimal(19,2)", "oid": "bigint", "regclass": "string", "regtype": "string", "vector": "array<float>",
}


def spark_type(tokens: list[Token]) -> tuple[str, int]:
    """Spark type named by the leading tokens, and how many they are."""
    word, i = tokens[0].text.lower(), 1
    args = ""
    if word == "double" and len(tokens) > 1 and tokens[1].low == "precision" or word == "character" and len(tokens) > 1 and tokens[1].low == "varying":
        i = 2
    if i < len(tokens) and tokens[i].text == "(":
        j = i
        while tokens[j].text != ")":
            j += 1
        args, i = "".join(t.text for t in tokens[i + 1 : j]), j + 1
    if word in ("timestamp", "time") and [t.low for t in tokens[i : i + 3]] in (["with", "time", "zone"], ["without", "time", "zone"]):
        word = "timestamptz" if tokens[i].low == "with" else word
        i += 3
    kind = f"decimal({args or '38,10'})" if word in ("numeric", "decimal") else TYPES.get(word, "string")
    while i + 1 < len(tokens) and tokens[i].text == "[" and (tokens[i + 1].text == "]" or tokens[i + 1].kind == "num"):
        i += 2 if tokens[i + 1].text == "]" else 3
        kind = f"array<{kind}>"
    return kind, i


def closing(tokens: list[Token], i: int) -> int:
    """Where the bracket opened at i is closed."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].kind == "op":
            depth += tokens[j].text in "([" and len(tokens[j].text) == 1
            depth -= tokens[j].text in ")]" and len(tokens[j].text) == 1
            if not depth:
                return j
    raise ValueError("syntax error: unbalanced brackets")


def split_list(tokens: list[Token]) -> list[list[Token]]:
    """Parts between commas outside brackets."""
    out, now, depth = [], [], 0
    for t in tokens:
        if t.kind == "op" and t.text in ("(", "["):
            depth += 1
        if t.kind == "op" and t.text in (")", "]"):
            depth -= 1
        if t.kind == "op" and t.text == "," and not depth:
            out.append(now)
            now = []
        else:
            now.append(t)
    return out + [now] if now or out else []


def raw(text: str) -> Token:
    return Token("raw", text)


def _operand_before(out: list[Token]) -> int:
    """Index at which the primary expression at the end of `out` begins."""
    i = len(out) - 1
    while True:
        if out[i].kind == "op" and out[i].text in (")", "]"):
            close = "(" if out[i].text == ")" else "["
            depth = 0
            while True:
                depth += out[i].kind == "op" and out[i].text in (")", "]")
                depth -= out[i].kind == "op" and out[i].text in ("(", "[")
                if not depth:
                    break
                i -= 1
            if close == "(" and i and out[i - 1].kind in ("name", "quoted") and out[i - 1].low not in _KEYWORDS or close == "[" and i and out[i - 1].kind != "op":
                i -= 1
        if i >= 2 and out[i - 1].kind == "op" and out[i - 1].text in (".", "::"):
            i -= 2
            continue
        return i


def _operand_after(tokens: list[Token], i: int) -> int:
    """Index after the primary expression that begins at i."""
    if tokens[i].kind == "op" and tokens[i].text == "-":
        i += 1
    typed = tokens[i].kind == "name" and i + 1 < len(tokens) and tokens[i + 1].kind == "str"
    i = closing(tokens, i) + 1 if tokens[i].text == "(" else i + 1 + typed
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "op" and t.text in ("(", "["):
            i = closing(tokens, i) + 1
        elif t.kind == "op" and t.text == ".":
            i += 2
        elif t.kind == "op" and t.text == "::":
            i += 1 + spark_type(tokens[i + 1 :])[1]
        else:
            return i
    return i


def _array_text(s: str) -> str:
    from larkspan.functions.arrays import parse_literal

    def one(v):
        return "array(" + ", ".join(map(one, v)) + ")" if isinstance(v, list) else "NULL" if v is None else v if re.fullmatch(r"-?\d+(\.\d+)?", str(v)) else show(Token("str", str(v)))

    return one(parse_literal(s))


def _json_step(s: str) -> str:
    """A path step from the Spark text of a key or an index."""
    m = re.fullmatch(r"'(.*)'", s, re.S)
    return f"['{m[1]}']" if m else f"[{s}]"


def _braces(s: str) -> str:
    steps = s[1:-1].strip("{}").split(",")
    return "".join(f"[{x.strip()}]" if x.strip().lstrip("-").isdigit() else f"[\\'{x.strip()}\\']" for x in steps)


def _get(a: str, step: str, as_text: bool) -> str:
    path = "'$" + step.replace("'", "\\'") + "'" if "\\'" not in step else f"'${step}'"
    v = f"try_variant_get(try_parse_json({a}), {path}, 'variant')"
    return f"CASE WHEN schema_of_variant({v}) RLIKE '^(OBJECT|ARRAY)' THEN to_json({v}) ELSE try_variant_get({v}, '$', 'string') END" if as_text else f"to_json({v})"


def _is_vector(a: str) -> bool:
    return bool(re.match(r"'\s*\[", a))


def _vector(a: str) -> str:
    return "array(" + ", ".join(f"CAST({x} AS DOUBLE)" for x in a.strip("'").strip().strip("[]").split(",")) + ")" if _is_vector(a) else f"CAST({a} AS ARRAY<DOUBLE>)"


def _fold(a: str, b: str, body: str) -> str:
    return f"aggregate(zip_with({_vector(a)}, {_vector(b)}, (x, y) -> {body}), CAST(0 AS DOUBLE), (s, x) -> s + x)"


def _array(a: str) -> str:
    return _array_text(a[1:-1]) if re.match(r"'\s*\{", a) else a


def _contains(a: str, b: str) -> str:
    if re.match(r"'\s*\{\s*(\}|\\?\")", b):  # a JSON object
        import json

        want = json.loads(b[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
        tests = [f"{_get(a, f'[{chr(92)}{chr(39)}{k}{chr(92)}{chr(39)}]', False)} = {show(Token('str', json.dumps(v, separators=(',', ':'), ensure_ascii=False)))}" for k, v in want.items()]
        return "(" + (" AND ".join(f"coalesce({t}, false)" for t in tests) or f"{a} IS NOT NULL") + ")"
    return f"(size(array_except({_array(b)}, {_array(a)})) = 0)"


_OPERATORS = {
    "->": lambda a, b: _get(a, _json_step(b), False),
    "->>": lambda a, b: _get(a, _json_step(b), True),
    "#>": lambda a, b: _get(a, _braces(b), False),
    "#>>": lambda a, b: _get(a, _braces(b), True),
    "@>": _contains,
    "<@": lambda a, b: _contains(b, a),
    "&&": lambda a, b: f"(size(array_intersect({_array(a)}, {_array(b)})) > 0)",
    "?": lambda a, b: f"coalesce(array_contains(json_object_keys({a}), {b}), false)",
    "?|": lambda a, b: f"coalesce(arrays_overlap(json_object_keys({a}), {_array(b)}), false)",
    "?&": lambda a, b: f"coalesce(size(array_except({_array(b)}, json_object_keys({a}))) = 0, false)",
    "<->": lambda a, b: f"sqrt({_fold(a, b, '(x - y) * (x - y)')})",
    "<+>": lambda a, b: _fold(a, b, "abs(x - y)"),
    "<#>": lambda a, b: f"(-{_fold(a, b, 'x * y')})",
    "<=>": lambda a, b: f"(1 - {_fold(a, b, 'x * y')} / (sqrt({_fold(a, a, 'x * y')}) * sqrt({_fold(b, b, 'x * y')})))",
    "~": lambda a, b: f"({a} RLIKE {b})",
    "~*": lambda a, b: f"({a} RLIKE concat('(?i)', {b}))",
    "!~": lambda a, b: f"(NOT {a} RLIKE {b})",
    "!~*": lambda a, b: f"(NOT {a} RLIKE concat('(?i)', {b}))",
    "~~": lambda a, b: f"({a} LIKE {b})",
    "~~*": lambda a, b: f"({a} ILIKE {b})",
    "!~~": lambda a, b: f"({a} NOT LIKE {b})",
    "!~~*": lambda a, b: f"({a} NOT ILIKE {b})",
    "^": lambda a, b: f"pow({a}, {b})",
    "#": lambda a, b: f"({a} ^ {b})",
    "@@": lambda a, b: macros.match(a, b),
    "<<": lambda a, b: f"shiftleft({a}, {b})",
    ">>": lambda a, b: f"shiftright({a}, {b})",
    "<<|": lambda a, b: f"(({a}).y2 < ({b}).y1)",
    "|>>": lambda a, b: f"(({a}).y1 > ({b}).y2)",
    "-|-": lambda a, b: macros.range_adjacent(a, b),
}


def _left(s: str, n: str) -> str:
    return f"substring({s}, 1, CASE WHEN {n} >= 0 THEN {n} ELSE greatest(length({s}) + {n}, 0) END)"


def _right(s: str, n: str) -> str:
    return f"CASE WHEN {n} >= 0 THEN substring({s}, greatest(length({s}) - {n}, 0) + 1, {n}) ELSE substring({s}, 1 - ({n}), length({s})) END"


def _regexp_replace(s: str, p: str, r: str, f: str = "''") -> str:
    flags = f.strip("'")
    inline = f"(?{'i' if 'i' in flags else ''}{'m' if 'n' in flags or 'm' in flags else ''})" if set(flags) & set("inm") else ""
    new = re.sub(r"\\\\(\d)", lambda m: f"${m[1]}", r)
    if "g" in flags:
        return f"regexp_replace({s}, concat('{inline}', {p}), {new})"
    new = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}", new)
    return f"regexp_replace({s}, concat('{inline}', '\\\\A((?s:.*?))(', {p}, ')'), concat('$1', {new}))"


def _date_trunc(field: str, ts: str, zone: str | None = None) -> str:
    span = {"'century'": 100, "'millennium'": 1000}.get(field.lower())
    if field.lower() == "'decade'":
        return f"make_timestamp_ntz(year({ts}) - year({ts}) % 10, 1, 1, 0, 0, 0)"
    if span:
        return f"make_timestamp_ntz(CAST(floor((year({ts}) - 1) / {span}) AS INT) * {span} + 1, 1, 1, 0, 0, 0)"
    if zone:
        return f"to_utc_timestamp(date_trunc({field}, from_utc_timestamp({ts}, {zone})), {zone})"
    return f"CAST(date_trunc({field}, {ts}) AS TIMESTAMP_NTZ)"


def date_field(field: str, ts: str) -> str:
    table = {
        "dow": f"dayofweek({ts}) - 1", "isodow": f"weekday({ts}) + 1", "doy": f"dayofyear({ts})", "week": f"weekofyear({ts})", "isoyear": f"extract(YEAROFWEEK FROM {ts})",
        "epoch": f"unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000", "decade": f"floor(year({ts}) / 10)", "century": f"floor((year({ts}) + 99) / 100)", "millennium": f"floor((year({ts}) + 999) / 1000)",
    }
    return f"CAST({table.get(field, f'extract({field} FROM {ts})')} AS DOUBLE)"


_FUNCTIONS = {
    "log": lambda *a: f"log10({a[0]})" if len(a) == 1 else f"(ln({a[1]}) / ln({a[0]}))",
    "concat": lambda *a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})",
    "left": _left,
    "right": _right,
    "strpos": lambda s, x: f"instr({s}, {x})",
    "chr": lambda n: f"decode(unhex(lpad(hex({n}), 4, '0')), 'UTF-16BE')",
    "to_hex": lambda n: f"lower(hex({n}))",
    "regexp_replace": _regexp_replace,
    "regexp_match": lambda s, p: f"CASE WHEN {s} RLIKE {p} THEN array(regexp_extract({s}, {p}, " + ("1" if "(" in p and "(?" not in p else "0") + ")) END",
    "regexp_split_to_array": lambda s, p: f"split({s}, {p}, -1)",
    "string_to_array": lambda s, d, *n: f"split({s}, concat('\\\\Q', {d}, '\\\\E'), -1)",
    "array_to_string": lambda *a: f"array_join({', '.join(a)})",
    "array_length": lambda a, d="1": f"nullif(size({a}), 0)",
    "array_upper": lambda a, d="1": f"nullif(size({a}), 0)",
    "array_lower": lambda a, d="1": f"CASE WHEN size({a}) > 0 THEN 1 END",
    "cardinality": lambda a: f"size({a})",
    "array_cat": lambda a, b: f"concat({a}, {b})",
    "array_position": lambda a, x: f"nullif(array_position({a}, {x}), 0)",
    "unnest": lambda a: f"explode({a})",
    "jsonb_array_length": lambda j: f"coalesce(json_array_length({j}), 0)",
    "json_typeof": lambda j: _FUNCTIONS["jsonb_typeof"](j),
    "jsonb_typeof": lambda j: f"CASE WHEN schema_of_variant(try_parse_json({j})) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(try_parse_json({j})) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(try_parse_json({j})) = 'STRING' THEN 'string' WHEN schema_of_variant(try_parse_json({j})) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(try_parse_json({j})) = 'VOID' THEN 'null' ELSE 'number' END",
    "json_build_object": lambda *a: "to_json(named_struct(" + ", ".join(a) + "), map('ignoreNullFields', 'false'))",
    "jsonb_build_object": lambda *a: _FUNCTIONS["json_build_object"](*a),
    "jsonb_extract_path_text": lambda j, *p: _get(j, "".join(_json_step(x) for x in p), True),
    "jsonb_extract_path": lambda j, *p: _get(j, "".join(_json_step(x) for x in p), False),
    "to_jsonb": lambda x: f"to_json({x})",
    "date_trunc": _date_trunc,
    "date_part": lambda f, ts: date_field(f.strip("'").lower(), ts),
    "to_timestamp": lambda x, *f: f"timestamp_micros(CAST(round({x} * 1000000) AS BIGINT))" if not f else f"to_timestamp({x}, '{_java(f[0])}')",
    "to_date": lambda x, f: f"to_date({x}, '{_java(f)}')",
    "to_char": lambda x, f: f"date_format({x}, '{_java(f)}')" if re.search("[YMDH]", f) else f"format_number({x}, {len(f.strip(chr(39)).partition('.')[2])})",
    "make_interval": lambda *a: f"make_interval({', '.join(a)})",
    "timezone": lambda z, ts: f"from_utc_timestamp({ts}, {z})",
    "clock_timestamp": lambda: "current_timestamp()",
    "statement_timestamp": lambda: "current_timestamp()",
    "transaction_timestamp": lambda: "current_timestamp()",
    "gen_random_uuid": lambda: "uuid()",
    "uuid_generate_v4": lambda: "uuid()",
    "random": lambda: "rand()",
    "trunc": lambda x, n="0": f"(signum({x}) * floor(abs({x}) * pow(10, {n})) / pow(10, {n}))",
    "div": lambda a, b: f"({a} div {b})",
    "pg_typeof": lambda x: f"typeof({x})",
    "l2_distance": lambda a, b: _OPERATORS["<->"](a, b),
    "cosine_distance": lambda a, b: _OPERATORS["<=>"](a, b),
    "inner_product": lambda a, b: _fold(a, b, "x * y"),
    "bool_and": lambda x: f"bool_and({x})",
    "version": lambda: "'larkspan on Spark'",
}


def _java(f: str) -> str:
    from larkspan.functions.datetimes import java_pattern

    return java_pattern(f.strip("'")).replace("'", "\\'")


_ORDER_ENDS = {"limit", "offset", "fetch", "rows", "range", "groups", "union", "intersect", "except", "for", "returning"}


def _null_order(item: list[Token]) -> list[Token]:
    if any(t.low == "nulls" for t in item):
        return item
    return [*item, raw("NULLS FIRST" if item[-1].low == "desc" else "NULLS LAST")]


def _aggregate(name: str, args: list[list[Token]], order: list[list[Token]], distinct: bool) -> str | None:
    """Aggregates whose Spark form has another shape."""
    shown = [text_of(a) for a in args]
    if name in ("array_agg", "json_agg", "jsonb_agg"):
        v = shown[0]
        if any(o[-1].low == "desc" for o in order):
            raise ValueError(f"{name} with a descending order is not supported; negate the key")
        if distinct:
            out = f"array_sort(collect_set({v}))"
        else:
            fields = [f for o in order for f in (f"({text_of(o)}) IS NULL", text_of(o))]
            named = ", ".join(f"'k{i}', {k}" for i, k in enumerate(fields))
            out = f"transform({'sort_array' if order else ''}(collect_list(named_struct({named + ', ' if named else ''}'v', {v}))), s -> s.v)"
        return out if name == "array_agg" else f"to_json({out})"
    if name == "string_agg":
        if distinct:  # PostgreSQL lets a DISTINCT aggregate be ordered by its argument only
            down = bool(order) and order[0][-1].low == "desc"
            return f"nullif(array_join(sort_array(collect_set({shown[0]}), {str(not down).lower()}), {shown[1]}), '')"
        inner = f"listagg({shown[0]}, {shown[1]})"
        return inner + (f" WITHIN GROUP (ORDER BY {', '.join(text_of(_null_order(o)) for o in order)})" if order else "")
    return None


_FUNCTIONS |= macros.MACROS


class Rewriter:
    """One pass over a token list; sub-expressions in brackets are rewritten first."""

    def __init__(self, session: dict | None = None, macros: dict | None = None):
        self.session, self.macros = session or {}, macros or {}

    def rewrite(self, tokens: list[Token]) -> list[Token]:
        tokens = self._distinct_on(tokens)
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind == "op" and t.text == "::":
                kind, n = spark_type(tokens[i + 1 :])
                at = _operand_before(out)
                body = text_of(out[at:])
                literal = out[-1] if len(out) - at == 1 and out[-1].kind == "str" else None
                value = _array_text(literal.text) if literal and kind.startswith("array") and literal.text.strip()[:1] in "{[" else body
                special = literal and macros.cast_literal(tokens[i + 1].low, body)
                out[at:] = [raw(special) if special else raw(self._interval(literal.text) if literal and tokens[i + 1].low == "interval" else f"CAST({value} AS {kind})" if literal else self._cast(value, kind))]
                i += 1 + n
            elif t.kind == "op" and t.text in _OPERATORS and out and not (t.text == "~" and out[-1].kind == "op" and out[-1].text not in (")", "]")) and not (out[-1].kind == "name" and out[-1].low in _KEYWORDS):
                j = _operand_after(tokens, i + 1)
                right = text_of(self.rewrite(tokens[i + 1 : j]))
                at = _operand_before(out)
                left = text_of(out[at:])
                out[at:] = [raw(macros.operator(t.text, left, right) or _OPERATORS[t.text](left, right))]
                i = j
            elif t.low == "array" and i + 1 < len(tokens) and tokens[i + 1].text == "[":
                j = closing(tokens, i + 1)
                out.append(raw(self._array(tokens[i + 1 : j + 1])))
                i = j + 1
            elif t.kind == "op" and t.text == "[" and out and out[-1].kind != "op" or t.kind == "op" and t.text == "[" and out and out[-1].text in (")", "]"):
                j = closing(tokens, i)
                at = _operand_before(out)
                inner = tokens[i + 1 : j]
                cut = next((k for k, x in enumerate(inner) if x.text == ":"), None)
                a = text_of(out[at:])
                if cut is None:
                    out[at:] = [raw(f"try_element_at({a}, {text_of(self.rewrite(inner))})")]
                else:
                    lo, hi = text_of(inner[:cut]) or "1", text_of(inner[cut + 1 :]) or f"size({a})"
                    out[at:] = [raw(f"slice({a}, {lo}, greatest({hi} - {lo} + 1, 0))")]
                i = j + 1
            elif t.low in ("any", "some", "all") and i + 1 < len(tokens) and tokens[i + 1].text == "(" and out and out[-1].kind == "op" and out[-1].text in ("=", "<>", "!=", "<", "<=", ">", ">=") and not (tokens[i + 2].low == "select" or tokens[i + 2].kind == "raw" and tokens[i + 2].text.startswith("SELECT")):
                j, op = closing(tokens, i + 1), out.pop().text
                arr = text_of(self.rewrite(tokens[i + 2 : j]))
                at = _operand_before(out)
                out[at:] = [raw(f"{'forall' if t.low == 'all' else 'exists'}({_array(arr)}, e -> {text_of(out[at:])} {op} e)")]
                i = j + 1
            elif t.low == "between" and i + 1 < len(tokens) and tokens[i + 1].low == "symmetric":
                j = next(k for k in range(i, len(tokens)) if tokens[k].low == "and")
                k = _operand_after(tokens, j + 1)
                a, b = text_of(self.rewrite(tokens[i + 2 : j])), text_of(self.rewrite(tokens[j + 1 : k]))
                out += [raw(f"BETWEEN least({a}, {b}) AND greatest({a}, {b})")]
                i = k
            elif t.low == "similar" and i + 1 < len(tokens) and tokens[i + 1].low == "to":
                negate = out[-1].low == "not"
                if negate:
                    out.pop()
                at = _operand_before(out)
                p = tokens[i + 2].text
                regex = "\\\\A(?:" + re.sub(r"([.^$])", r"\\\\\1", p).replace("%", "(?s:.*)").replace("_", "(?s:.)").replace("'", "\\'") + ")\\\\z"
                out[at:] = [raw(f"({'NOT ' * negate}{text_of(out[at:])} RLIKE '{regex}')")]
                i += 3
            elif t.low in ("current_user", "session_user", "current_role", "user") and t.low in self.session:
                out.append(Token("str", self.session[t.low]))
                i += 1
            elif t.low == "limit" and i + 1 < len(tokens) and tokens[i + 1].low in ("all", "null"):
                i += 2
            elif t.low == "fetch" and i + 2 < len(tokens) and tokens[i + 1].low in ("first", "next"):
                out += [raw("LIMIT"), tokens[i + 2]]
                i += 5
            elif t.low == "order" and i + 1 < len(tokens) and tokens[i + 1].low == "by":
                j = i + 2
                while j < len(tokens) and not (tokens[j].low in _ORDER_ENDS or tokens[j].text in (")", ";") and tokens[j].kind == "op"):
                    j = closing(tokens, j) + 1 if tokens[j].text == "(" else j + 1
                out += [raw("ORDER BY"), raw(", ".join(text_of(_null_order(self.rewrite(x))) for x in split_list(tokens[i + 2 : j])))]
                i = j
            elif t.low == "lateral" and i + 2 < len(tokens) and tokens[i + 1].kind == "name" and tokens[i + 2].text == "(" and tokens[i + 1].low.startswith("json"):
                i += 1  # the function's own text says LATERAL
            elif t.kind == "name" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and t.low not in _KEYWORDS | {"values", "cast", "row"} or t.low in ("left", "right") and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                j = closing(tokens, i + 1)
                done = self._call(t, tokens[i + 2 : j], tokens[j + 1 :], out)
                out += done[0]
                i = j + 1 + done[1]
            elif t.low == "cast" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                j = closing(tokens, i + 1)
                inner = tokens[i + 2 : j]
                k = max(x for x, y in enumerate(inner) if y.low == "as")
                out.append(raw(self._cast(text_of(self.rewrite(inner[:k])), spark_type(inner[k + 1 :])[0])))
                i = j + 1
            elif t.kind == "op" and t.text == "(":
                j = closing(tokens, i)
                out += [t, *self.rewrite(tokens[i + 1 : j]), tokens[j]]
                i = j + 1
            elif t.low in (*macros.RANGES, "point", "box") and i + 1 < len(tokens) and tokens[i + 1].kind == "str":
                out.append(raw(macros.cast_literal(t.low, show(tokens[i + 1]))))
                i += 2
            elif t.low in ("interval", "date", "timestamp") and i + 1 < len(tokens) and tokens[i + 1].kind == "str":
                s, text = show(tokens[i + 1]), tokens[i + 1].text
                if t.low == "interval" and i + 2 < len(tokens) and tokens[i + 2].low in UNITS and text.strip().lstrip("+-").replace(".", "", 1).isdigit():
                    text += f" {tokens[i + 2].low}"  # INTERVAL '60' DAY
                    i += 1
                bound = i + 2 < len(tokens) and tokens[i + 2].low in ("preceding", "following")
                out.append(raw(self._bound(text) if bound and t.low == "interval" else self._interval(text) if t.low == "interval" else f"DATE {s}" if t.low == "date" else f"TIMESTAMP_NTZ {s}"))
                i += 2
            else:
                out.append(t)
                i += 1
        return out

    @staticmethod
    def _cast(body: str, kind: str) -> str:
        """CAST; to an integer type it rounds, which Spark's own cast does not."""
        return f"CAST(CAST({body} AS DECIMAL(38, 0)) AS {kind})" if kind in ("int", "bigint", "smallint") else f"CAST({body} AS {kind})"

    def _interval(self, s: str) -> str:
        from larkspan.functions.intervals import parse

        months, days, micros = parse(s)
        return f"make_interval(0, {months}, 0, {days}, 0, 0, CAST({micros} AS DECIMAL(20, 0)) / 1000000)"

    def _bound(self, s: str) -> str:
        """A frame's offset, which Spark wants as a literal of days and time."""
        from larkspan.functions.intervals import parse

        months, days, micros = parse(s)
        if months:
            raise ValueError("months are not supported in RANGE offsets")
        seconds, rest = divmod(days * 86_400_000_000 + micros, 1_000_000)
        return f"INTERVAL '{seconds}.{rest:06d}' SECOND"

    def _array(self, tokens: list[Token]) -> str:
        parts = [self._array(p) if p[0].text == "[" else text_of(self.rewrite(p)) for p in split_list(tokens[1:-1])]
        return f"array({', '.join(parts)})"

    def _call(self, name: Token, inner: list[Token], after: list[Token], out: list[Token]) -> tuple[list[Token], int]:
        low = name.low
        distinct = bool(inner) and inner[0].low == "distinct"
        body = inner[1:] if distinct else inner
        cut = next((k for k in range(len(body) - 1) if body[k].low == "order" and body[k + 1].low == "by" and _depth(body, k) == 0), None)
        order = [self.rewrite(x) for x in split_list(body[cut + 2 :])] if cut is not None else []
        args = [self.rewrite(x) for x in split_list(body[:cut] if cut is not None else body)]
        if low in ("rank", "dense_rank", "percent_rank", "cume_dist") and args and [x.low for x in after[:2]] == ["within", "group"]:
            j = closing(after, 2)
            x, v = text_of(self.rewrite([t for t in after[5:j] if t.low not in ("asc", "desc")])), text_of(args[0])
            form = {"rank": f"count_if({x} < {v}) + 1", "dense_rank": f"count(DISTINCT CASE WHEN {x} < {v} THEN {x} END) + 1", "percent_rank": f"coalesce(count_if({x} < {v}) / nullif(count(*), 0), 0)", "cume_dist": f"(count_if({x} <= {v}) + 1) / (count(*) + 1)"}
            return [raw(f"({form[low]})")], j + 1
        if low in ("extract",) and len(inner) > 2 and inner[1].low == "from":
            return [raw(date_field((inner[0].text).lower(), text_of(self.rewrite(inner[2:]))))], 0
        if low in ("substring", "trim", "position", "overlay") and any(x.low in ("in", "placing", "from", "for", "leading", "trailing", "both") for x in inner):
            return [raw(f"{low}({text_of(self.rewrite(inner))})")], 0
        if low == "count" and len(inner) == 3 and inner[1].text == "." and inner[2].text == "*":
            return [raw("count(*)")], 0
        if low in ("generate_series", "json_each", "jsonb_each", "json_each_text", "jsonb_each_text", "json_array_elements", "jsonb_array_elements", "json_object_keys", "jsonb_object_keys"):
            return [raw(self._table_function(low, [text_of(a) for a in args], bool(out) and (out[-1].low in ("from", "join", "lateral") or out[-1].text == ",") and any(x.low == "from" for x in out)))], 0
        shaped = _aggregate(low, args, order, distinct)
        if shaped:
            return [raw(shaped)], 0
        if low in self.macros:
            return [raw(self.macros[low](*[text_of(a) for a in args]))], 0
        shown = [text_of(a) for a in args]
        if low in _FUNCTIONS and not distinct and not order and not (after and after[0].low == "over"):
            return [raw(_FUNCTIONS[low](*shown))], 0
        if low.startswith("jsonb_") or low.startswith("json_"):
            low = low.replace("jsonb_", "json_")
        return [raw(f"{show(name)}({'DISTINCT ' * distinct}{', '.join(shown)}{' ORDER BY ' + ', '.join(map(text_of, order)) if order else ''})")], 0

    def _table_function(self, low: str, a: list[str], in_from: bool) -> str:
        if low == "generate_series":
            start, stop, step = (*a, "1")[:3]
            seq = f"CASE WHEN ({step} > 0 AND {start} > {stop}) OR ({step} < 0 AND {start} < {stop}) THEN slice(array({start}), 1, 0) ELSE sequence({start}, CASE WHEN ({step} > 0 AND {start} > {stop}) OR ({step} < 0 AND {start} < {stop}) THEN {start} ELSE {stop} END, {step}) END"
            return f"(SELECT explode({seq}) AS generate_series)" if in_from else f"explode({seq})"
        if "each" in low:
            value = "x.value" if low.endswith("_text") else "x.value"
            keys = f"from_json({a[0]}, 'map<string,variant>')"
            conv = f"try_variant_get({value}, '$', 'string')" if low.endswith("_text") else f"to_json({value})"
            return f"LATERAL (SELECT x.key AS key, {conv} AS value FROM (SELECT explode(map_entries({keys})) AS x))"
        item = f"json_object_keys({a[0]})" if "keys" in low else f"transform(from_json({a[0]}, 'array<variant>'), x -> to_json(x))"
        return f"LATERAL (SELECT explode({item}) AS value)" if in_from else f"explode({item})"

    def _distinct_on(self, tokens: list[Token]) -> list[Token]:
        i = next((k for k in range(len(tokens) - 2) if tokens[k].low == "select" and tokens[k + 1].low == "distinct" and tokens[k + 2].low == "on" and _depth(tokens, k) == 0), None)
        if i is None:
            return tokens
        j = closing(tokens, i + 3)
        keys = tokens[i + 4 : j]
        rest, depth, cuts = tokens[j + 1 :], 0, {}
        for k, t in enumerate(rest):
            depth += t.kind == "op" and t.text == "("
            depth -= t.kind == "op" and t.text == ")"
            if not depth and t.low in ("from", "order", "limit", "offset"):
                cuts.setdefault(t.low, k)
        end = min([cuts[c] for c in ("order", "limit", "offset") if c in cuts], default=len(rest))
        tail = min([cuts[c] for c in ("limit", "offset") if c in cuts], default=len(rest))
        order = split_list(rest[cuts["order"] + 2 : tail]) if "order" in cuts else split_list(keys)
        names = [f"__o{k}" for k in range(len(order))]
        bare = [[t for t in o if t.low not in ("asc", "desc", "nulls", "first", "last")] for o in order]
        tailed = [[t for t in o if t.low in ("asc", "desc", "nulls", "first", "last")] for o in order]
        columns = split_list(rest[: cuts["from"]])
        hidden = [x for n, b in zip(names, bare) for x in (Token("op", ","), *b, Token("name", "AS"), Token("name", n))]
        ordered = [x for k, o in enumerate(order) for x in ([Token("op", ",")] * (k > 0) + o)]
        window = [Token("op", ","), Token("name", "row_number"), Token("op", "("), Token("op", ")"), Token("name", "OVER"), Token("op", "("), Token("name", "PARTITION"), Token("name", "BY"), *keys, Token("name", "ORDER"), Token("name", "BY"), *ordered, Token("op", ")"), Token("name", "AS"), Token("name", "__rn")]
        inner = [Token("name", "SELECT"), *[x for k, c in enumerate(columns) for x in ([Token("op", ",")] * (k > 0) + c)], *hidden, *window, *rest[cuts["from"] : end]]
        outer_order = ", ".join(f"{n} {text_of(t)}".strip() + ("" if any(x.low == "nulls" for x in t) else " NULLS FIRST" if any(x.low == "desc" for x in t) else " NULLS LAST") for n, t in zip(names, tailed))
        return [*tokens[:i], raw(f"SELECT * EXCEPT (__rn, {', '.join(names)}) FROM ("), *self.rewrite(inner), raw(f") WHERE __rn = 1 ORDER BY {outer_order}"), *rest[tail:]]


def _depth(tokens: list[Token], k: int) -> int:
    return sum((t.text == "(") - (t.text == ")") for t in tokens[:k] if t.kind == "op")


@lru_cache(maxsize=256)
def _cached(text: str, session: tuple) -> str:
    return text_of(Rewriter(dict(session)).rewrite(lex(text)))


def to_spark(text: str, session: dict | None = None, macros: dict | None = None) -> str:
    """Spark SQL of one query; results without macros are cached."""
    if macros:
        return text_of(Rewriter(session, macros).rewrite(lex(text)))
    return _cached(text, tuple(sorted((session or {}).items())))
