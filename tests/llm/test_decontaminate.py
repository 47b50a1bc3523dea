import random

import pytest
from larkspan.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, containment int"


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, t=0.8):
    out = []
    for i, text in items:
        n = len((text or "").encode().split())
        if n:
            k = min(5, n)
            s = sets_of(text, k)
            for d, body in docs:
                both = len(s & sets_of(body, k))
                if both >= t * len(s) - 1e-9:
                    out.append((d, i, len(s), both))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [50_000, 7])
def test_random_edits_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 25, 33, 70])))) for i in range(30)] + [(90, None), (91, ""), (None, "null id item with several words"), (92, items_repeat := "a b a b a b a b a b"), (93, items_repeat)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            x = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.randrange(3)):
                if x:
                    x[rng.randrange(len(x))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (None, docs[3][1]), (3, docs[3][1]), (502, "y " * 600_000 + (items[20][1] or ""))]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], DOCS)
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontaminate.find_items(df, it).collect()), key=str)
    want = brute(docs, items)
    assert got == want and len(want) > 60
    kept = decontaminate.drop_contaminated(df, it)
    bad = {(d, t) for d, t in docs if any(m[0] == d for m in brute([(d, t)], items))}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(d or -1 for d, t in docs if (d, t) not in bad)
    assert kept.columns == df.columns


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", None, None)], DOCS)
    it = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_items(df.limit(0), it).count() == 0
    assert decontaminate.find_items(df, it.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, it.limit(0)).count() == 1
    assert decontaminate.find_items(df, it).count() == 1
