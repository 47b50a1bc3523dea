"""Full-text search: tsvector is map<lexeme, array<position>>, a tsquery a tree that becomes a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import bind, col

# English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself "
    "no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
# Suffixes in the order in which they are tried, the length that a word must exceed, and what takes their place.
SUFFIXES = (
    ("ies", 4, "y"), ("es", 4, ""), ("ing", 5, ""), ("ly", 4, ""), ("ed", 4, ""), ("er", 4, ""), ("ment", 6, ""), ("ness", 6, ""), ("tion", 6, ""),
    ("ational", 8, "ate"), ("tional", 7, "tion"), ("iveness", 8, "ive"), ("ousness", 8, "ous"),
)


def stem_word(w: str) -> str:
    """Light stemmer: trailing s's go, then the first suffix of the table that fits."""
    w = w.rstrip("s")
    for suffix, longer_than, new in SUFFIXES:
        if w.endswith(suffix) and len(w) > longer_than:
            return w[: -len(suffix)] + new
    return w


def stem(w: Column) -> Column:
    """stem_word() as an expression."""
    base = F.regexp_replace(w, "s+$", "")
    out = None
    for suffix, longer_than, new in SUFFIXES:
        test = base.endswith(suffix) & (F.length(base) > longer_than)
        value = F.concat(F.substring(base, F.lit(1), F.length(base) - len(suffix)), F.lit(new))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(base)


def words(text) -> Column:
    """Alphanumeric runs, lower-cased."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def to_tsvector(text, config: str = "english") -> Column:
    """Lexemes of at least two characters with their positions from 1; `simple` neither stems nor drops stop words."""
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))
    if config == "english":
        placed = F.transform(F.filter(placed, lambda s: ~s["w"].isin(*STOP_WORDS)), lambda s: F.struct(stem(s["w"]).alias("w"), s["p"].alias("p")))
    placed = F.filter(placed, lambda s: F.length(s["w"]) >= 2)
    def grouped(p: Column) -> Column:
        """Sorted (w, p): a new lexeme begins where w changes, and its positions are a slice."""
        n = F.size(p)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(p, i - 1)["w"] != F.get(p, i - 2)["w"]))
        entry = lambda b: F.transform(b, lambda i, k: F.struct(F.get(p, i - 1)["w"].alias("key"), F.transform(F.slice(p, i, F.coalesce(F.get(b, k + 1), n + 1) - i), lambda s: s["p"]).alias("value")))
        empty = F.slice(F.array(F.struct(F.lit("").alias("key"), F.array(F.lit(0)).alias("value"))), 1, 0)
        return F.when(n > 0, bind(begins, entry)).otherwise(F.when(p.isNotNull(), empty))

    return F.map_from_entries(bind(F.array_sort(placed), grouped))


@dataclass(frozen=True)
class Node:
    """A query tree: op is lexeme, and, or, not, or phrase (with the distances of its lexemes)."""

    op: str
    parts: tuple = ()
    gaps: tuple = ()


def _lexeme(w: str, config: str) -> Node | None:
    found = [x for x in re.findall(r"[^\W_]+", w.lower())]
    if not found:
        return None
    if config == "english":
        found = [stem_word(x) for x in found if x not in STOP_WORDS]
    found = [x for x in found if len(x) >= 2]
    nodes = [Node("lexeme", (x,)) for x in found]
    return nodes[0] if len(nodes) == 1 else Node("and", tuple(nodes)) if nodes else None


def _join(op: str, parts: list) -> Node | None:
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else Node(op, tuple(parts)) if parts else None


def to_tsquery(text: str, config: str = "english") -> Node | None:
    """Operators & | ! <-> <n> and parentheses; stop words drop out."""
    tokens = re.findall(r"<->|<\d+>|[&|!()]|'(?:[^']|'')*'|[^\s&|!()<]+", text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom():
        t = peek()
        if t is None:
            raise ValueError(f'syntax error in tsquery: "{text}"')
        take()
        if t == "!":
            inner = atom()
            return inner and Node("not", (inner,))
        if t == "(":
            out = either()
            if peek() != ")":
                raise ValueError(f'syntax error in tsquery: "{text}"')
            take()
            return out
        if t in ("&", "|", ")") or t.startswith("<"):
            raise ValueError(f'syntax error in tsquery: "{text}"')
        return _lexeme(t.strip("'").removesuffix(":*"), config)

    def phrase():
        parts, gaps = [atom()], []
        while (t := peek()) is not None and t.startswith("<"):
            take()
            gaps.append(1 if t == "<->" else int(t[1:-1]))
            parts.append(atom())
        if len(parts) == 1:
            return parts[0]
        return _phrase(parts, gaps)

    def both():
        parts = [phrase()]
        while peek() == "&":
            take()
            parts.append(phrase())
        return _join("and", parts)

    def either():
        parts = [both()]
        while peek() == "|":
            take()
            parts.append(both())
        return _join("or", parts)

    if not tokens:
        return None
    out = either()
    if at != len(tokens):
        raise ValueError(f'syntax error in tsquery: "{text}"')
    return out


def _phrase(parts: list, gaps: list) -> Node | None:
    """A phrase in which a dropped stop word widens the gap."""
    kept, wide, pending = [], [], 0
    for i, p in enumerate(parts):
        step = gaps[i - 1] if i else 0
        if p is None:
            pending += step
        else:
            if kept:
                wide.append(step + pending)
            pending = 0
            kept.append(p)
    if not kept:
        return None
    return kept[0] if len(kept) == 1 else Node("phrase", tuple(kept), tuple(wide))


def plainto_tsquery(text: str, config: str = "english") -> Node | None:
    return _join("and", [_lexeme(w, config) for w in re.findall(r"[^\W_]+", text)])


def phraseto_tsquery(text: str, config: str = "english") -> Node | None:
    parts = [_lexeme(w, config) for w in re.findall(r"[^\W_]+", text)]
    return _phrase(parts, [1] * (len(parts) - 1))


def websearch_to_tsquery(text: str, config: str = "english") -> Node | None:
    """Quotes make phrases, - negates, `or` is OR; never an error."""
    either, both = [], []
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', text):
        if plain.lower() == "or" and not minus:
            either.append(_join("and", both))
            both = []
            continue
        node = phraseto_tsquery(quoted, config) if quoted else plainto_tsquery(plain.strip('"'), config)
        both.append(Node("not", (node,)) if minus and node else node)
    either.append(_join("and", both))
    return _join("or", either)


def matches(vector, query: Node | None) -> Column:
    """tsvector @@ tsquery; an empty query matches nothing."""
    v = col(vector)
    if query is None:
        return F.when(v.isNotNull(), F.lit(False))
    if query.op == "lexeme":
        return F.map_contains_key(v, query.parts[0])
    if query.op == "not":
        return ~matches(v, query.parts[0])
    if query.op == "phrase":
        ends = _positions(v, query.parts[0])
        for gap, part in zip(query.gaps, query.parts[1:]):
            here = _positions(v, part)
            ends = F.array_intersect(_shift(ends, gap), here)
        return F.size(ends) > 0
    out = matches(v, query.parts[0])
    for p in query.parts[1:]:
        out = (out & matches(v, p)) if query.op == "and" else (out | matches(v, p))
    return out


def _shift(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def _positions(v: Column, node: Node) -> Column:
    if node.op != "lexeme":
        raise ValueError("phrases are made of single lexemes")
    return F.coalesce(F.try_element_at(v, F.lit(node.parts[0])), F.array().cast("array<int>"))


def lexemes(query: Node | None, positive: bool = True) -> list[str]:
    """The lexemes of a query that are not negated."""
    if query is None:
        return []
    if query.op == "lexeme":
        return [query.parts[0]] if positive else []
    return [x for p in query.parts for x in lexemes(p, positive != (query.op == "not"))]


def ts_rank(vector, query: Node | None) -> Column:
    """Share of the query's positive lexemes that the vector has."""
    want = sorted(set(lexemes(query)))
    if not want:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.map_keys(col(vector)), F.array(*map(F.lit, want)))) / float(len(want))


def ts_headline(text, query: Node | None, start: str = "<b>", stop: str = "</b>", config: str = "english") -> Column:
    """The text with the words whose lexeme is in the query between marks."""
    want = sorted(set(lexemes(query)))
    if not want:
        return col(text)
    gaps = F.split(col(text), r"[\p{L}\p{N}]+", -1)
    found = F.regexp_extract_all(col(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    marked = F.transform(found, lambda w: F.when((stem(F.lower(w)) if config == "english" else F.lower(w)).isin(*want), F.concat(F.lit(start), w, F.lit(stop))).otherwise(w))
    return F.array_join(F.zip_with(gaps, marked, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def setweight(vector, weight: str) -> Column:
    """Positions with a weight letter, as text; lexemes stay."""
    return F.transform_values(col(vector), lambda k, v: F.transform(v, lambda p: F.concat(p.cast("string"), F.lit(weight.upper()))))


def strip(vector) -> Column:
    """Without positions."""
    return F.transform_values(col(vector), lambda k, v: F.slice(v, 1, 0))


def concat(a, b) -> Column:
    """a || b: b's positions follow a's last one."""
    a, b = col(a), col(b)
    last = F.coalesce(F.array_max(F.flatten(F.map_values(a))), F.lit(0))
    moved = F.transform_values(b, lambda k, v: F.transform(v, lambda p: p + last))
    return F.map_zip_with(a, moved, lambda k, x, y: F.concat(F.coalesce(x, F.array().cast("array<int>")), F.coalesce(y, F.array().cast("array<int>"))))


def to_text(vector) -> Column:
    """'lex':1,2 entries in lexeme order."""
    e = F.array_sort(F.map_entries(col(vector)))
    return F.array_join(F.transform(e, lambda x: F.concat(F.lit("'"), x["key"], F.lit("'"), F.when(F.size(x["value"]) > 0, F.concat(F.lit(":"), F.array_join(x["value"].cast("array<string>"), ","))).otherwise(""))), " ")


def numnode(query: Node | None) -> int:
    """Lexemes and operators of a query."""
    if query is None:
        return 0
    if query.op == "lexeme":
        return 1
    return sum(map(numnode, query.parts)) + (1 if query.op == "not" else len(query.parts) - 1)


def querytree(query: Node | None) -> str:
    """The query as text."""
    if query is None:
        return ""
    if query.op == "lexeme":
        return f"'{query.parts[0]}'"
    if query.op == "not":
        return f"!{querytree(query.parts[0])}"
    sign = {"and": " & ", "or": " | "}.get(query.op)
    texts = [f"( {querytree(p)} )" if p.op in ("and", "or") and p.op != query.op else querytree(p) for p in query.parts]
    if sign:
        return sign.join(texts)
    return texts[0] + "".join(f" <{'-' if g == 1 else g}> {t}" for g, t in zip(query.gaps, texts[1:]))
