import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from larkspan.llm import mixing

DOCS = "doc_id long, text string, source string, taken string, size int"


def test_targets():
    t = mixing.targets([("a", 100), ("b", 100), (None, 100)])
    assert t == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    t = mixing.targets([("b", 10), ("a", 1000)], weights=(1.0, 3.0))
    assert t["b"] == 20 and t["a"] == pytest.approx(1.5 * 1010 - 20)
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 0)]) == {"a": 0.0}


def test_knapsack_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), 4)))
        counts = np.array([rng.randrange(4) for _ in range(4)])
        budget = rng.randrange(1, 120)
        take = mixing.knapsack(lengths, counts, budget)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := int(np.dot(c, lengths))) <= budget)
        assert (take <= counts).all() and (take * lengths).sum() == best


def test_fit_large_and_long():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(0, 20_000, 3000))
    counts = rng.integers(1, 2000, len(lengths))
    for part in (0.01, 0.5, 0.999):
        budget = int(part * (lengths * counts).sum())
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= 1
    take = mixing.fit(np.array([100_000]), np.array([7]), 340_000)
    assert take.tolist() == [3]


def check(rows, docs):
    size = {i: len((t or "").encode().split()) for i, t, *_ in docs}
    by = defaultdict(int)
    for d in docs:
        by[d[2]] += len((d[1] or "").encode().split())
    goal = mixing.targets(list(by.items()))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    return goal, taken, size


def test_documents_hit_their_targets_and_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    rows = mixing.mix_sources(df).collect()
    goal, taken, size = check(rows, docs)
    assert all(r["size"] == size[r["doc_id"]] for r in rows)
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    again = mixing.mix_sources(df.repartition(7).orderBy("text")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows_and_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 20)
    docs = [(1000 + i, "a b c", "hot") for i in range(500)] + [(9, None, None), (10, "", None), (None, "x y", None), (None, "x y", None), (11, "z " * 400_000, "long"), (12, "\u00e9 \u00e8\u00a0x", "")]
    rows = mixing.mix_sources(spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS)).collect()
    goal, taken, _ = check(rows, docs)
    assert abs(taken["hot"] - goal["hot"]) <= 3
    assert next(r["size"] for r in rows if r["doc_id"] == 12) == 2
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_targets_of_any_number_of_sources(spark):
    """source_targets() against targets(), null and empty sources among them."""
    import random

    rng = random.Random(3)
    cases = [[], [("a", 0)], [(None, 5), ("", 7), ("é", 0), ("z", 1)], [(f"s{k}", int(10 ** rng.uniform(0, 7))) for k in range(700)] + [(None, 12345)], [("a", 10), ("b", 10**6), ("c", 3), ("Z", 10**5)]]
    for rows in cases:
        df = spark.createDataFrame(rows, "source string, size long").repartition(3)
        got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(df).collect()}
        want = mixing.targets(rows)
        assert set(got) == set(want) and all(got[s][0] == n for s, n in rows)
        assert all(abs(got[s][1] - want[s]) <= 1e-9 * max(1, want[s]) for s in want), rows


def test_take_mix_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(k, "w " * (k % 5), "s", 1, 2, 3, 4) for k in range(30)], "doc_id long, text string, source string, mix_times int, _mix_id int, size int, times int")
    out = mixing.take_mix(df)
    assert out.columns == [*df.columns, "mix_times_"] and out.count() > 0 and {(r["mix_times"], r["_mix_id"], r["size"], r["times"]) for r in out.collect()} == {(1, 2, 3, 4)}
    assert mixing.take_mix(df.limit(0)).count() == 0
