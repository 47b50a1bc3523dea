"""SQL texts of functions whose arguments or results need more than another name.

Every entry takes the Spark texts of its arguments and gives a Spark text.
"""

from __future__ import annotations

import re

from larkspan.functions import fulltext
from larkspan.functions.intervals import parse


def text(s: str) -> str:
    """A string as a Spark literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value(literal: str) -> str:
    """The string of a Spark literal."""
    if not re.fullmatch(r"'.*'", literal, re.S):
        raise ValueError(f"a literal is needed here, not {literal}")
    return re.sub(r"\\(.)", r"\1", literal[1:-1])


def _inline(flags: str) -> str:
    return f"(?{''.join(sorted(set(flags) & set('im')))})" if set(flags) & set("im") else ""


def _tail(s: str, start: str) -> str:
    return s if start == "1" else f"substring({s}, {start}, length({s}))"


def format_(fmt: str, *args: str) -> str:
    out, rest = [], list(args)
    for piece in re.split(r"(%[sIL%])", value(fmt)):
        if piece == "%%":
            out.append("'%'")
        elif piece in ("%s", "%I"):
            out.append(f"coalesce(CAST({rest.pop(0)} AS STRING), '')")
        elif piece == "%L":
            v = f"CAST({rest.pop(0)} AS STRING)"
            out.append(f"coalesce(concat('\\'', replace({v}, '\\'', '\\'\\''), '\\''), 'NULL')")
        elif piece:
            out.append(text(piece))
    return f"concat({', '.join(out)})" if out else "''"


def encode(x: str, form: str) -> str:
    b = f"CAST({x} AS BINARY)"
    return {"hex": f"lower(hex({b}))", "base64": f"base64({b})", "escape": f"replace(decode({b}, 'ISO-8859-1'), '\\\\', '\\\\\\\\')"}.get(value(form).lower(), f"encode({x}, {form})")


def decode(x: str, form: str) -> str:
    return {"hex": f"unhex({x})", "base64": f"unbase64({x})"}.get(value(form).lower(), f"decode({x}, {form})")


def _micros(interval: str) -> int:
    """Microseconds of an interval literal without months."""
    m = re.match(r"make_interval\(0, (-?\d+), 0, (-?\d+), 0, 0, CAST\((-?\d+) AS", interval)
    months, days, micros = (int(m[1]), int(m[2]), int(m[3])) if m else parse(value(interval))
    if months or days * 86_400_000_000 + micros <= 0:
        raise ValueError("stride must be greater than zero and have no months")
    return days * 86_400_000_000 + micros


def date_bin(stride: str, ts: str, origin: str = "TIMESTAMP_NTZ '2000-01-01'") -> str:
    t, o = (f"unix_micros(CAST({x} AS TIMESTAMP))" for x in (ts, origin))
    return f"CAST(timestamp_micros({t} - pmod({t} - {o}, {_micros(stride)})) AS TIMESTAMP_NTZ)"


def age(a: str, b: str | None = None) -> str:
    """Whole months, then days (a borrowed month has the earlier month's days), then time, as an interval."""
    a, b = ("CAST(current_date() AS TIMESTAMP_NTZ)", a) if b is None else (a, b)
    a, b = f"CAST({a} AS TIMESTAMP_NTZ)", f"CAST({b} AS TIMESTAMP_NTZ)"
    hi, lo = f"greatest({a}, {b})", f"least({a}, {b})"
    clock = lambda t: f"pmod(unix_micros(CAST({t} AS TIMESTAMP)), 86400000000)"
    borrow = f"CAST({clock(hi)} < {clock(lo)} AS INT)"
    days = f"(day({hi}) - day({lo}) - {borrow})"
    short = f"CAST({days} < 0 AS INT)"
    sign = f"CASE WHEN {a} < {b} THEN -1 ELSE 1 END"
    months = f"((year({hi}) - year({lo})) * 12 + month({hi}) - month({lo}) - {short})"
    return f"make_interval(0, {sign} * {months}, 0, {sign} * ({days} + {short} * day(last_day({lo}))), 0, 0, CAST({sign} * ({clock(hi)} - {clock(lo)} + {borrow} * 86400000000) AS DECIMAL(20, 0)) / 1000000)"


def array_fill(v: str, shape: str, *_) -> str:
    m = re.fullmatch(r"array\((.*)\)", shape)
    for n in reversed(m[1].split(",") if m else [f"({shape})[0]"]):
        v = f"array_repeat({v}, {n.strip()})"
    return v


# ranges: structs of lo, hi, lo_inc, hi_inc, empty

RANGES = {"int4range": "int", "int8range": "bigint", "numrange": "decimal(38,10)", "daterange": "date", "tsrange": "timestamp_ntz", "tstzrange": "timestamp"}


def make_range(kind: str, lo: str, hi: str, bounds: str = "'[)'") -> str:
    left, right = value(bounds)[0] == "[", value(bounds)[1] == "]"
    lo, hi = f"CAST({lo} AS {kind})", f"CAST({hi} AS {kind})"
    if kind in ("int", "bigint", "date"):
        step = (lambda c: f"date_add({c}, 1)") if kind == "date" else (lambda c: f"CAST({c} + 1 AS {kind})")
        lo, hi, left, right = lo if left else step(lo), step(hi) if right else hi, True, False
    empty = f"coalesce({lo} > {hi}{f' OR {lo} = {hi}' if not (left and right) else ''}, false)"
    return f"named_struct('lo', {lo}, 'hi', {hi}, 'lo_inc', {str(left).lower()}, 'hi_inc', {str(right).lower()}, 'empty', {empty})"


def range_literal(kind: str, s: str) -> str:
    t = value(s).strip()
    if t.lower() == "empty":
        return f"named_struct('lo', CAST(NULL AS {kind}), 'hi', CAST(NULL AS {kind}), 'lo_inc', false, 'hi_inc', false, 'empty', true)"
    m = re.fullmatch(r"([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])", t)
    if not m:
        raise ValueError(f'malformed range literal: "{t}"')
    part = lambda x: text(x.strip('"')) if x else "NULL"
    return make_range(kind, part(m[2]), part(m[3]), text(m[1] + m[4]))


def is_range(s: str) -> bool:
    return s.startswith("named_struct('lo'")


def range_has(r: str, e: str) -> str:
    r = f"({r})"
    return f"(NOT {r}.empty AND ({r}.lo IS NULL OR {r}.lo < {e} OR ({r}.lo_inc AND {r}.lo = {e})) AND ({r}.hi IS NULL OR {e} < {r}.hi OR ({r}.hi_inc AND {r}.hi = {e})))"


def range_left(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    return f"(NOT {a}.empty AND NOT {b}.empty AND coalesce({a}.hi < {b}.lo OR ({a}.hi = {b}.lo AND NOT ({a}.hi_inc AND {b}.lo_inc)), false))"


def range_overlaps(a: str, b: str) -> str:
    return f"(NOT ({a}).empty AND NOT ({b}).empty AND NOT {range_left(a, b)} AND NOT {range_left(b, a)})"


def range_contains(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    low = f"({a}.lo IS NULL OR coalesce({a}.lo < {b}.lo OR ({a}.lo = {b}.lo AND ({a}.lo_inc OR NOT {b}.lo_inc)), false))"
    high = f"({a}.hi IS NULL OR coalesce({b}.hi < {a}.hi OR ({b}.hi = {a}.hi AND ({a}.hi_inc OR NOT {b}.hi_inc)), false))"
    return f"({b}.empty OR (NOT {a}.empty AND {low} AND {high}))"


def range_adjacent(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    touch = lambda x, y: f"coalesce({x}.hi = {y}.lo AND {x}.hi_inc <> {y}.lo_inc, false)"
    return f"(NOT {a}.empty AND NOT {b}.empty AND ({touch(a, b)} OR {touch(b, a)}))"


# geometry: points are structs of x, y; boxes of x1, y1, x2, y2


def point(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def box(a: str, b: str) -> str:
    c = [f"({p}).{k}" for p in (a, b) for k in "xy"]
    return f"named_struct('x1', least({c[0]}, {c[2]}), 'y1', least({c[1]}, {c[3]}), 'x2', greatest({c[0]}, {c[2]}), 'y2', greatest({c[1]}, {c[3]}))"


def geometry_literal(kind: str, s: str) -> str:
    n = re.findall(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", value(s))
    if len(n) != {"point": 2, "box": 4}[kind]:
        raise ValueError(f'invalid input syntax for type {kind}: "{value(s)}"')
    return point(*n) if kind == "point" else box(point(*n[:2]), point(*n[2:]))


def is_point(s: str) -> bool:
    return s.startswith("named_struct('x',")


def is_box(s: str) -> bool:
    return s.startswith("named_struct('x1'")


def distance(a: str, b: str) -> str:
    return f"sqrt(pow(({a}).x - ({b}).x, 2) + pow(({a}).y - ({b}).y, 2))"


def box_overlaps(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    return f"({a}.x1 <= {b}.x2 AND {b}.x1 <= {a}.x2 AND {a}.y1 <= {b}.y2 AND {b}.y1 <= {a}.y2)"


def box_contains(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    return f"({a}.x1 <= {b}.x1 AND {a}.y1 <= {b}.y1 AND {a}.x2 >= {b}.x2 AND {a}.y2 >= {b}.y2)"


# full text


def _config(args: tuple[str, ...]) -> tuple[str, str]:
    return (value(args[0]), args[1]) if len(args) > 1 else ("english", args[0])


def to_tsvector(*args: str) -> str:
    config, t = _config(args)
    word = "s.w"
    placed = f"transform(regexp_extract_all(lower({t}), '([\\\\p{{L}}\\\\p{{N}}]+)', 1), (w, i) -> named_struct('w', w, 'p', i + 1))"
    if config == "english":
        base = "regexp_replace(s.w, 's+$', '')"
        arms = " ".join(f"WHEN endswith({base}, '{x}') AND length({base}) > {n} THEN concat(substring({base}, 1, length({base}) - {len(x)}), '{new}')" for x, n, new in fulltext.SUFFIXES)
        stops = ", ".join(map(text, fulltext.STOP_WORDS))
        placed = f"transform(filter({placed}, s -> s.w NOT IN ({stops})), s -> named_struct('w', CASE {arms} ELSE {base} END, 'p', s.p))"
    placed = f"array_sort(filter({placed}, s -> length({word}) >= 2))"
    begins = "filter(sequence(1, greatest(size(p), 1)), i -> size(p) > 0 AND (i = 1 OR get(p, i - 1).w <> get(p, i - 2).w))"
    entries = "transform(b, (i, k) -> struct(get(p, i - 1).w, transform(slice(p, i, coalesce(get(b, k + 1), size(p) + 1) - i), s -> s.p)))"
    return f"get(transform(array({placed}), p -> get(transform(array({begins}), b -> map_from_entries({entries})), 0)), 0)"


def _matches(v: str, q) -> str:
    if q is None:
        return "false"
    if q.op == "lexeme":
        return f"map_contains_key({v}, {text(q.parts[0])})"
    if q.op == "not":
        return f"(NOT {_matches(v, q.parts[0])})"
    if q.op == "phrase":
        at = lambda n: f"coalesce(try_element_at({v}, {text(n.parts[0])}), CAST(array() AS ARRAY<INT>))"
        ends = at(q.parts[0])
        for gap, part in zip(q.gaps, q.parts[1:]):
            ends = f"array_intersect(transform({ends}, x -> x + {gap}), {at(part)})"
        return f"(size({ends}) > 0)"
    return "(" + (" AND " if q.op == "and" else " OR ").join(_matches(v, p) for p in q.parts) + ")"


#: Marks a query tree inside Spark text until the operator that uses it is met.
_QUERIES: dict[str, object] = {}


def query(make, *args: str) -> str:
    config, t = _config(args)
    key = f"'tsquery:{len(config)}:{config}:{make.__name__}:' || {t}"
    _QUERIES[key] = make(value(t), config)
    return key


def match(a: str, b: str) -> str:
    """tsvector @@ tsquery, text @@ text and the like."""
    v, q = (a, b) if b in _QUERIES else (b, a) if a in _QUERIES else (a, query(fulltext.plainto_tsquery, b))
    v = v if v.startswith("get(transform(array(array_sort") or "map" in v else to_tsvector(v) if v.startswith("'") else v
    return f"get(transform(array({v}), v -> {_matches('v', _QUERIES[q])}), 0)"


def rank(v: str, q: str, *_) -> str:
    want = sorted(set(fulltext.lexemes(_QUERIES[q])))
    return f"size(array_intersect(map_keys({v}), array({', '.join(map(text, want))}))) / {len(want)}D" if want else "0D"


MACROS = {
    "format": format_,
    "encode": encode,
    "decode": decode,
    "date_bin": date_bin,
    "age": age,
    "regexp_like": lambda s, p, f="''": f"regexp_like({s}, concat('{_inline(value(f))}', {p}))",
    "regexp_count": lambda s, p, start="1", f="''": f"regexp_count({_tail(s, start)}, concat('{_inline(value(f))}', {p}))",
    "regexp_substr": lambda s, p, start="1", n="1", f="''": f"get(regexp_extract_all({_tail(s, start)}, concat('{_inline(value(f))}', {p}), 0), {n} - 1)",
    "regexp_matches": lambda s, p, f="''": f"explode(transform({'' if 'g' in f else 'slice('}regexp_extract_all({s}, concat('{_inline(value(f))}', {p}), {1 if '(' in p and '(?' not in p else 0}){'' if 'g' in f else ', 1, 1)'}, x -> array(x)))",
    "regexp_split_to_table": lambda s, p: f"explode(split({s}, {p}, -1))",
    "string_to_table": lambda s, d: f"explode(split({s}, concat('\\\\Q', {d}, '\\\\E'), -1))",
    "array_replace": lambda a, x, y: f"transform({a}, e -> CASE WHEN e <=> {x} THEN {y} ELSE e END)",
    "array_remove": lambda a, x: f"filter({a}, e -> NOT e <=> {x})",
    "array_positions": lambda a, x: f"filter(transform({a}, (e, i) -> CASE WHEN e <=> {x} THEN i + 1 END), i -> i IS NOT NULL)",
    "trim_array": lambda a, n: f"slice({a}, 1, greatest(size({a}) - {n}, 0))",
    "array_fill": array_fill,
    "array_ndims": lambda a: f"CASE WHEN size({a}) > 0 THEN 1 END",
    "array_dims": lambda a: f"CASE WHEN size({a}) > 0 THEN concat('[1:', size({a}), ']') END",
    "array_reverse": lambda a: f"reverse({a})",
    "array_shuffle": lambda a: f"shuffle({a})",
    "array_sample": lambda a, n: f"slice(shuffle({a}), 1, {n})",
    "array_to_json": lambda a: f"to_json({a})",
    "row_to_json": lambda r: f"to_json({r}, map('ignoreNullFields', 'false'))",
    "overlay": lambda s, r, i, n=None: f"overlay({s} PLACING {r} FROM {i}{f' FOR {n}' if n else ''})",
    "jsonb_path_exists": lambda j, p: f"(get_json_object({j}, {p}) IS NOT NULL)",
    "jsonb_path_query_first": lambda j, p: f"get_json_object({j}, {p})",
    "jsonb_exists": lambda j, k: f"coalesce(array_contains(json_object_keys({j}), {k}), false)",
    "uuid_extract_version": lambda u: f"CAST(conv(substring({u}, 15, 1), 16, 10) AS INT)",
    "isfinite": lambda x: f"({x} IS NOT NULL AND CAST({x} AS STRING) NOT IN ('Infinity', '-Infinity', 'NaN'))",
    "trim_scale": lambda x: f"regexp_replace(regexp_replace(CAST({x} AS STRING), '(\\\\.\\\\d*?)0+$', '$1'), '\\\\.$', '')",
    "booland_statefunc": lambda a, b: f"({a} AND {b})",
    "boolor_statefunc": lambda a, b: f"({a} OR {b})",
    "l1_distance": None,
    "to_tsvector": to_tsvector,
    "to_tsquery": lambda *a: query(fulltext.to_tsquery, *a),
    "plainto_tsquery": lambda *a: query(fulltext.plainto_tsquery, *a),
    "phraseto_tsquery": lambda *a: query(fulltext.phraseto_tsquery, *a),
    "websearch_to_tsquery": lambda *a: query(fulltext.websearch_to_tsquery, *a),
    "ts_rank": rank,
    "ts_rank_cd": rank,
    "numnode": lambda q: str(fulltext.numnode(_QUERIES[q])),
    "querytree": lambda q: text(fulltext.querytree(_QUERIES[q])),
    "isempty": lambda r: f"({r}).empty",
    "lower_inc": lambda r: f"({r}).lo_inc",
    "upper_inc": lambda r: f"({r}).hi_inc",
    "lower_inf": lambda r: f"(NOT ({r}).empty AND ({r}).lo IS NULL)",
    "upper_inf": lambda r: f"(NOT ({r}).empty AND ({r}).hi IS NULL)",
    "lower": lambda x: f"({x}).lo" if is_range(x) else f"lower({x})",
    "upper": lambda x: f"({x}).hi" if is_range(x) else f"upper({x})",
    "range_contains": lambda r, e: range_contains(r, e) if is_range(e) else range_has(r, e),
    "range_overlaps": range_overlaps,
    "range_adjacent": range_adjacent,
    "range_left": range_left,
    "range_right": lambda a, b: range_left(b, a),
    "point": lambda x, y=None: point(x, y) if y else geometry_literal("point", x),
    "box": lambda a, b=None: box(a, b) if b else geometry_literal("box", a),
    **{name: (lambda lo, hi, b="'[)'", k=kind: make_range(k, lo, hi, b)) for name, kind in RANGES.items()},
}
del MACROS["l1_distance"]


def operator(op: str, a: str, b: str) -> str | None:
    """Operators over ranges, points, boxes and full text, where a side shows what it is."""
    if op == "@@":
        return match(a, b)
    if is_range(a) or is_range(b):
        if op == "@>":
            return range_contains(a, b) if is_range(b) else range_has(a, b)
        if op == "<@":
            return range_contains(b, a) if is_range(a) else range_has(b, a)
        form = {"&&": range_overlaps, "<<": range_left, ">>": lambda x, y: range_left(y, x), "-|-": range_adjacent}.get(op)
        return form(a, b) if form else None
    if is_point(a) and is_point(b) and op == "<->":
        return distance(a, b)
    if is_box(a) or is_box(b):
        left = lambda x, y: f"(({x}).x2 < ({y}).x1)"
        below = lambda x, y: f"(({x}).y2 < ({y}).y1)"
        form = {"&&": box_overlaps, "@>": box_contains, "<@": lambda x, y: box_contains(y, x), "<<": left, ">>": lambda x, y: left(y, x), "<<|": below, "|>>": lambda x, y: below(y, x)}.get(op)
        return form(a, b) if form else None
    return None


def cast_literal(kind: str, s: str) -> str | None:
    """'...'::type for types of this module."""
    if kind in RANGES:
        return range_literal(RANGES[kind], s)
    return geometry_literal(kind, s) if kind in ("point", "box") else None
