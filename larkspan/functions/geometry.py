"""Points and boxes as structs of double, with the operators over them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.strings import col

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _numbers(text: str, n: int, what: str) -> list[float]:
    found = [float(x) for x in re.findall(_NUMBER, text)]
    if len(found) != n:
        raise ValueError(f'invalid input syntax for type {what}: "{text}"')
    return found


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def box(x1, y1, x2, y2) -> Column:
    """Corners in any order; kept as low and high ones."""
    v = [_c(k).cast("double") for k in (x1, y1, x2, y2)]
    return F.struct(F.least(v[0], v[2]).alias("x1"), F.least(v[1], v[3]).alias("y1"), F.greatest(v[0], v[2]).alias("x2"), F.greatest(v[1], v[3]).alias("y2"))


def circle(x, y, r) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), _c(r).cast("double").alias("r"))


def parse_point(text: str) -> Column:
    return point(*_numbers(text, 2, "point"))


def parse_box(text: str) -> Column:
    return box(*_numbers(text, 4, "box"))


def parse_lseg(text: str) -> Column:
    n = _numbers(text, 4, "lseg")
    return F.struct(point(*n[:2]).alias("a"), point(*n[2:]).alias("b"))


def parse_circle(text: str) -> Column:
    return circle(*_numbers(text, 3, "circle"))


def from_text(s, kind: str) -> Column:
    """A text column of points, boxes or circles."""
    n = {"point": 2, "box": 4, "circle": 3}[kind]
    found = F.regexp_extract_all(col(s), F.lit(f"({_NUMBER})"), F.lit(1))
    v = [F.get(found, F.lit(i)).cast("double") for i in range(n)]
    return F.when(F.size(found) == n, {"point": point, "box": box, "circle": circle}[kind](*v))


def distance(a, b) -> Column:
    """a <-> b of points."""
    a, b = col(a), col(b)
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def overlaps(a, b) -> Column:
    """a && b: touching counts."""
    a, b = col(a), col(b)
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def contains(a, b) -> Column:
    """a @> b."""
    a, b = col(a), col(b)
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def contained(a, b) -> Column:
    return contains(b, a)


def contains_point(a, p) -> Column:
    a, p = col(a), col(p)
    return p["x"].between(a["x1"], a["x2"]) & p["y"].between(a["y1"], a["y2"])


def left_of(a, b) -> Column:
    """a << b."""
    return col(a)["x2"] < col(b)["x1"]


def right_of(a, b) -> Column:
    """a >> b."""
    return col(a)["x1"] > col(b)["x2"]


def below(a, b) -> Column:
    """a <<| b."""
    return col(a)["y2"] < col(b)["y1"]


def above(a, b) -> Column:
    """a |>> b."""
    return col(a)["y1"] > col(b)["y2"]


def is_horizontal(a, b) -> Column:
    """a ?- b of points."""
    return col(a)["y"] == col(b)["y"]


def is_vertical(a, b) -> Column:
    """a ?| b of points."""
    return col(a)["x"] == col(b)["x"]
