"""JSON operators and functions over JSON text; native except for deep containment and deletion."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import bind, col

_MAP, _LIST = "map<string,variant>", "array<variant>"
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"} | dict.fromkeys("-0123456789", "number")


def _path(steps) -> str:
    """A JSONPath of keys and indexes (an int, or a text of digits, is an index)."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) or str(s).lstrip("-").isdigit() else f"['{s}']" for s in steps)


def _steps(path) -> list:
    return [x.strip().strip('"') for x in path.strip("{}").split(",") if x.strip()] if isinstance(path, str) else list(path)


def parse(j) -> Column:
    """The text as VARIANT; NULL if it is no JSON."""
    return F.try_parse_json(col(j))


def get(j, step) -> Column:
    """j -> key or index, as JSON text; a JSON null stays `null`."""
    return path(j, [step])


def get_text(j, step) -> Column:
    """j ->> key or index, as plain text."""
    return path_text(j, [step])


def path(j, steps) -> Column:
    """j #> path as JSON text."""
    return F.to_json(F.try_variant_get(parse(j), _path(_steps(steps)), "variant"))


def path_text(j, steps) -> Column:
    """j #>> path as plain text; JSON null is NULL, containers are JSON text."""
    v = F.try_variant_get(parse(j), _path(_steps(steps)), "variant")
    return F.when(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _kind(text: Column) -> Column:
    """Type of a valid JSON text by its first character; no schema is worked out."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.try_element_at(kinds, F.substring(F.ltrim(text, F.lit(" \t\n\r")), 1, 1))


def typeof(j) -> Column:
    """jsonb_typeof(); NULL if the text is no JSON."""
    return F.when(is_json(j), _kind(col(j)))


def typeof_at(v, steps) -> Column:
    """jsonb_typeof(v #> steps) of a parsed document; NULL where there is nothing."""
    return _kind(F.to_json(F.try_variant_get(col(v), _path(_steps(steps)), "variant")))


def array_length_at(v, steps) -> Column:
    """jsonb_array_length(v #> steps) of a parsed document; 0 for what is no array."""
    return F.coalesce(F.size(F.try_variant_get(col(v), _path(_steps(steps)), "array<variant>")), F.when(col(v).isNotNull(), 0))


def array_length(j) -> Column:
    """jsonb_array_length(): 0 for what is no array."""
    return F.coalesce(F.json_array_length(col(j)), F.when(col(j).isNotNull(), 0))


def keys(j) -> Column:
    return F.json_object_keys(col(j))


def has_key(j, key: str) -> Column:
    """j ? key, over top-level keys."""
    return F.coalesce(F.array_contains(keys(j), key), F.when(col(j).isNotNull(), False))


def has_any(j, wanted: list[str]) -> Column:
    """j ?| keys."""
    return F.coalesce(F.arrays_overlap(keys(j), F.array(*map(F.lit, wanted))), F.when(col(j).isNotNull(), False))


def has_all(j, wanted: list[str]) -> Column:
    """j ?& keys."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), keys(j))) == 0, F.when(col(j).isNotNull(), False))


def entries(j) -> Column:
    """Entries (key, value as JSON text) of an object in key order."""
    fields = F.from_json(col(j), _MAP)
    return bind(fields, lambda m: F.transform(F.sort_array(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.to_json(F.element_at(m, k)).alias("value"))))


def elements(j) -> Column:
    """Elements of an array as JSON texts."""
    return F.transform(F.from_json(col(j), _LIST), lambda v: F.to_json(v))


def merge(a, b) -> Column:
    """a || b of objects: b's keys win."""
    ma, mb = F.from_json(col(a), _MAP), F.from_json(col(b), _MAP)
    return F.to_json(F.map_concat(F.map_filter(ma, lambda k, v: ~F.map_contains_key(mb, k)), mb))


def delete_key(j, *wanted: str) -> Column:
    """j - key(s) of an object."""
    return F.to_json(F.map_filter(F.from_json(col(j), _MAP), lambda k, v: ~k.isin(*wanted)))


def delete_index(j, i: int) -> Column:
    """j - index of an array, negative from the end."""
    a = F.from_json(col(j), _LIST)
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.to_json(F.filter(a, lambda v, k: k != at))


def _contains(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_contains(x, y) for x in a) for y in b)
    if isinstance(a, list):
        return any(not isinstance(x, (dict, list)) and _contains(x, b) for x in a)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def contains(a, b) -> Column:
    """a @> b. A literal object of scalars is native; anything else goes to an Arrow-batched function."""
    if isinstance(b, str):
        want = json.loads(b)
        if isinstance(want, dict) and all(isinstance(v, (str, int)) and not isinstance(v, bool) for v in want.values()):
            tests = [has_key(a, k) & F.coalesce((typeof(get(a, k)) == ("string" if isinstance(v, str) else "number")) & (path_text(a, [k]) == str(v)), F.lit(False)) for k, v in want.items()]
            out = F.lit(True)
            for t in tests:
                out = out & t
            return F.when(col(a).isNotNull(), out)
        b = F.lit(b)

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _contains(json.loads(p), json.loads(q)) for p, q in zip(x, y)], dtype="object")

    return F.pandas_udf(batch, "boolean")(col(a), b)


def contained(a, b) -> Column:
    """a <@ b."""
    return contains(b, a if isinstance(a, Column) else F.col(a))


def delete_path(j, steps) -> Column:
    """j #- path."""
    steps = _steps(steps)

    def batch(x: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            v = top = json.loads(t)
            for s in steps[:-1]:
                v = v.get(s) if isinstance(v, dict) else v[int(s)] if isinstance(v, list) and -len(v) <= int(s) < len(v) else None
            last = steps[-1]
            if isinstance(v, dict):
                v.pop(last, None)
            elif isinstance(v, list) and -len(v) <= int(last) < len(v):
                del v[int(last)]
            return json.dumps(top, separators=(",", ":"), ensure_ascii=False)

        return x.map(one)

    return F.pandas_udf(batch, "string")(col(j))


def path_exists(j, p: str) -> Column:
    """jsonb_path_exists() for paths of keys, indexes and [*]."""
    return F.when(col(j).isNotNull(), F.coalesce(F.get_json_object(col(j), p), F.to_json(F.try_variant_get(parse(j), p.replace("[*]", "[0]"), "variant"))).isNotNull())


def path_query_array(j, p: str) -> Column:
    """jsonb_path_query_array() as JSON text."""
    v = F.get_json_object(col(j), p)
    return F.when(v.isNull(), "[]").otherwise(v if "[*]" in p else F.concat(F.lit("["), path(j, p.lstrip("$.").split(".")), F.lit("]")))


def build_object(*pairs) -> Column:
    """json_build_object(k, v, ...): NULL values stay."""
    named = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(pairs[::2], pairs[1::2])]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def build_array(*values) -> Column:
    """json_build_array() of any types."""
    one = lambda v: F.when(v.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    return F.concat(F.lit("["), F.concat_ws(",", *[one(v if isinstance(v, Column) else F.lit(v)) for v in values]), F.lit("]"))


def row_to_json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def is_json(j) -> Column:
    return parse(j).isNotNull()


def array_agg_json(x, *order) -> Column:
    """json_agg(x ORDER BY order): NULLs stay, NULL over no rows."""
    from larkspan.functions.aggregates import array_agg

    return F.to_json(array_agg(x, *order), {"ignoreNullFields": "false"})


def object_agg(key, value, *order) -> Column:
    """json_object_agg(key, value): the last of equal keys in the given order stays."""
    from larkspan.functions.aggregates import array_agg

    pairs = array_agg(F.struct(col(key).alias("key"), col(value).alias("value")), *(order or (key,)))
    latest = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.to_json(F.map_from_entries(latest), {"ignoreNullFields": "false"})
