"""EXCLUDE frames against brute force."""

import itertools
import math

import pytest
from larkspan.operators.windows import exclude_frame
from pyspark.sql import functions as F

ROWS = [(g, k, i, None if i % 5 == 2 else v) for i, (g, k, v) in enumerate([("a", 1, 1e17), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("a", 2, 4.5), ("a", 4, -1.0), ("a", None, 7.0), ("a", None, 8.0), ("b", 3, 5.0)])]


def brute(kind, rows, start, end, exclude, frame):
    out = {}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        keys = [r[1] for r in part]
        peer = [len(set(keys[: i + 1])) for i in range(len(part))]
        for i, r in enumerate(part):
            place = (lambda j: j - i) if frame == "rows" else (lambda j: peer[j] - peer[i])
            inside = [j for j in range(len(part)) if (start is None or place(j) >= start) and (end is None or place(j) <= end)]
            gone = {"CURRENT ROW": lambda j: j == i, "GROUP": lambda j: peer[j] == peer[i], "TIES": lambda j: peer[j] == peer[i] and j != i, "NO OTHERS": lambda j: False}[exclude]
            values = [part[j][3] for j in inside if not gone(j)]
            some = [v for v in values if v is not None]
            out[r[2]] = {"sum": lambda: math.fsum(some) if some else None, "count": lambda: len(some), "avg": lambda: math.fsum(some) / len(some) if some else None, "min": lambda: min(some, default=None), "max": lambda: max(some, default=None), "array_agg": lambda: sorted(map(str, values)) or None}[kind]()
    return out


@pytest.mark.parametrize("frame", ["rows", "groups"])
@pytest.mark.parametrize("exclude", ["CURRENT ROW", "GROUP", "TIES", "NO OTHERS"])
def test_exclude(spark, frame, exclude):
    df = spark.createDataFrame(ROWS, "g string, k int, i int, v double").repartition(1)
    bounds = [(None, None), (None, 0), (-1, 1), (-2, None), (None, -2), (2, None), (1, 2), (-3, -1), (0, 0)]
    wanted, outs = {}, []
    now = df
    for (a, b), kind in itertools.chain(itertools.product(bounds, ["sum", "array_agg"]), itertools.product(bounds[:4], ["count", "avg", "min", "max"])):
        name = f"{kind}_{len(outs)}"
        now = exclude_frame(now, kind, F.col("v"), name, ["g"], ["k"], a, b, exclude, frame)
        outs.append(name)
        wanted[name] = (kind, a, b)
    got = now.collect()
    for name, (kind, a, b) in wanted.items():
        want = brute(kind, ROWS, a, b, exclude, frame)
        for r in got:
            have = r[name]
            if kind == "array_agg":
                have = None if have is None else sorted(map(str, have))
            close = isinstance(have, float) and want[r["i"]] is not None and math.isclose(have, want[r["i"]], rel_tol=1e-12)
            assert close or have == want[r["i"]], (name, a, b, r["i"], have, want[r["i"]])
