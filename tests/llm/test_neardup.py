import random

import numpy as np
import pyarrow as pa
import pytest
from larkspan.llm import neardup
from larkspan.llm.components import components
from larkspan.llm.neardup import distinct_sets, near_duplicates, superminhash

DOCS = "doc_id long, text string, component_id long, kept string"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    s = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            root[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(s[i]), least, rows[i][0] == least) for i in g]
    return sorted(out, key=str)


def result(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, **kw).collect()), key=str)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    base = "one two three four five six seven eight"
    rows = [(9, base), (3, base.upper()), (4, None), (5, ""), (6, " \t"), (7, "a b"), (8, "A  b"), (None, "z z z z z z"), (None, "z z z z z z z"), (1, "solo text here"), (1, "solo text here"), (2, "k " * 300_000), (12, "q"), (12, "q r s t u v")]
    assert result(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block", [320, 8])
def test_large_family_and_chains(spark, block):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, i = [], 0
    for _ in range(60):  # a chain of edits: ends are far apart, neighbours close
        rows.append((1000 - i, " ".join(text)))
        text[rng.randrange(120)] = f"n{i}"
        i += 1
    for k in range(60):  # copies of one base with more and more edits
        t = list(text)
        for _ in range(k % 7):
            t[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((2000 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, block_sets=block) == brute(rows)


def test_null_ids_and_repeated_rows(spark):
    """1,000 rows without an id, some alike, and a hot row: each text is met once."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(500)]
    rows = [(None, t) for t in texts] * 2 + [(None, texts[0] + " more"), (7, texts[1] + " more"), (0, texts[2] + " more")] + [(9, "a b c d e f g h i")] * 700
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {}
    for r in got:
        by.setdefault(r[2], []).append(r)
    assert len(got) == len(rows) and len(by[7]) == 3 and len(by[0]) == 3 and len(by[9]) == 700 and len(by[None]) == 997
    assert sum(r[3] for r in by[7]) == 1 and sum(r[3] for r in by[0]) == 1


def test_boilerplate_family(spark):
    """Many texts that share half of their words, so that bands chain them, and some true pairs among them."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(common + [f"w{rng.randrange(10**7)}" for _ in range(60)])) for k in range(1500)]
    rows += [(5000 + k, rows[k * 3][1] + " tail") for k in range(100)]
    got = {r[0]: r[2] for r in result(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {k: k for k in range(1500)} | {5000 + k: k * 3 for k in range(100)}


def test_representatives_keep_columns_and_agree(spark):
    rows = [(1, "a b c d e f", k, 0, 0, 0) for k in (3, 1, 2)] + [(2, "A b c d e f", 4, 0, 0, 0), (None, "x y", 5, 0, 0, 0), (0, "x y", 6, 0, 0, 0), (None, None, 7, 0, 0, 0), (3, "", 8, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n.o` int, _kept_id int, _KEPT_hash int, node int")
    a = neardup.keep_representatives(df)
    assert a.columns == df.columns
    kept = sorted(tuple(r)[:3] for r in a.collect() if r[0] is not None)
    assert [r[0] for r in kept] == [0, 1, 3] and kept == sorted(tuple(r)[:3] for r in neardup.keep_representatives(df.orderBy("`n.o`").repartition(3)).collect() if r[0] is not None)
    assert neardup.keep_representatives(df.limit(0)).count() == 0


def definition(values, m):
    """SuperMinHash element by element, with the same draws."""
    from larkspan.llm.textkernel import mix

    out = [None] * m
    with np.errstate(over="ignore"):
        for x in values:
            p = list(range(m))
            for j in range(m):
                a = np.array([x], np.uint64)
                k = j + int(mix(a + np.uint64(2 * j + 1) * np.uint64(0x9E3779B97F4A7C15))[0] % np.uint64(m - j))
                p[j], p[k] = p[k], p[j]
                r = (j << 57) | int(mix(a ^ (np.uint64(2 * j + 2) * np.uint64(0xC2B2AE3D27D4EB4F)))[0] >> np.uint64(7))
                out[p[j]] = r if out[p[j]] is None else min(out[p[j]], r)
    return out


def test_signature_matches_definition_and_estimates():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 30, 500)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = superminhash(np.concatenate(sets), off, 24)
    assert sig.tolist() == [definition(s, 24) for s in sets]
    common, errors = rng.integers(0, 2**63, 800).astype(np.uint64), []
    for _ in range(40):
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
        s = superminhash(np.concatenate([a, b]), np.array([0, 900, 1800]), 120)
        errors.append((s[0] == s[1]).mean() - 0.8)
        common = rng.integers(0, 2**63, 800).astype(np.uint64)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    up = {}
    for _ in range(100):
        for a, b in edges:
            m = min(up.get(a, a), up.get(b, b))
            up[a] = up[b] = m
    assert got == {n: r for n, r in up.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_distinct_sets():
    h, o = distinct_sets(np.array([3, 1, 3, 2], np.uint64), np.array([0, 3, 3, 4]))
    assert h.tolist() == [1, 3, 2] and o.tolist() == [0, 2, 2, 3]
