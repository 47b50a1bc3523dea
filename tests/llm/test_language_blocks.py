import random

import numpy as np
from larkspan.llm import language

DOCS = "doc_id long, text string, lang string"


def test_more_labels_than_a_block_holds(spark):
    rng = random.Random(3)
    tongue = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 6))) for _ in range(12)] for k in range(70)}
    text = {k: [" ".join(rng.choices(w, k=25)) for _ in range(3)] for k, w in tongue.items()}
    rows = [(4 * i + j % 2, t, k) for i, (k, ts) in enumerate(text.items()) for j, t in enumerate(ts)]  # none is held out
    df = spark.createDataFrame([*rows, (10_000, None, "l00"), (10_001, "... 12", "l01")], DOCS)
    model = language.train(df)
    assert model.languages == sorted(tongue) and len(model.models) == 2
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) + 2
    want = {(i, k) for i, _, k in rows}
    assert {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] < 10_000} == want
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 10_000} == {"und"}
    assert language.keep_identified(df, model).count() == len(rows)


def test_blocks_score_like_one_model():
    rng = random.Random(5)
    counts = {f"l{k}": language.count_contexts(["".join(rng.choices("abcde ", k=200))]) for k in range(7)}
    one = language.Model(counts)
    parts = language.Blocks([language.Model({k: counts[k] for k in ks}) for ks in (("l0", "l1", "l2"), ("l3", "l4", "l5"), ("l6",))])
    data = np.frombuffer(b"".join("".join(rng.choices("abcdefg ", k=50)).encode() for _ in range(9)), np.uint8)
    bounds = np.append(np.arange(0, 401, 50), [450, 450])  # the last text is empty
    bits = one.lengths(data, bounds)
    best, least, total = parts.shortest(data, bounds)
    assert (best == bits.argmin(axis=1)).all() and np.allclose(least, bits.min(axis=1), rtol=1e-5)
    assert np.allclose(total, np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1), rtol=1e-3)
