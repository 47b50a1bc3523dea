import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from larkspan.llm import kneserney as kn
from larkspan.llm import registry

DOCS = "doc_id long, text string, n_tokens string, score int"


def tokens(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + ["</s>"]


class Plain:
    """The model by its formulas, over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.raw, self.known = order, Counter(), {}
        grams = Counter()
        for t in texts:
            ws = tokens(t)
            self.raw.update(ws)
            padded = ["<s>"] * (order - 1) + ws
            grams.update(tuple(padded[i : i + order]) for i in range(len(ws)))
        self.level = {order: grams}
        for k in range(order - 1, 0, -1):
            self.level[k] = Counter(g[1:] for g in self.level[k + 1])
        self.d, self.context = {}, {}
        for k, c in self.level.items():
            seen = Counter(c.values())
            self.d[k] = (0.0, *kn.discounts([seen[i] for i in (1, 2, 3, 4)]))
            self.context[k] = defaultdict(list)
            for g, n in c.items():
                self.context[k][g[:-1]].append(n)

    def p(self, gram):
        if gram not in self.known:
            self.known[gram] = self._p(gram)
        return self.known[gram]

    def _p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.raw) + 1)
        below = self.p(gram[1:])
        counts = self.context[k].get(gram[:-1])
        if not counts:
            return below if k > 1 or self.raw else 1.0
        n, d = sum(counts), self.d[k]
        c = self.level[k].get(gram, 0)
        return (c - d[min(c, 3)]) / n + sum(d[min(x, 3)] for x in counts) / n * below

    def score(self, text):
        ws = tokens(text)
        padded = ["<s>"] * (self.order - 1) + ws
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(ws)))


def held(i):
    return zlib.crc32((b"" if i is None else str(i).encode())) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_formulas(spark, order, monkeypatch):
    monkeypatch.setattr(kn, "HELD", 3000)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 50").collect()]
    rows += [(900, None), (901, ""), (902, "Ünseen wörds only"), (None, "the THE the"), (3, rows[3][1]), (903, "the of " * 3_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    model = kn.train(df.filter(~kn.held_out_column()), order=order, shards=5)
    plain = Plain([t for i, t in rows if not held(i)], order)
    n, v = sum(plain.raw.values()), len(plain.raw)
    assert (model.tokens, model.vocabulary) == (n, v)
    got = kn.score(df, model, kn.held_out_column()).collect()
    assert len(got) == len(rows)
    by = {(i, len(tokens(t))): t for i, t in rows}
    for r in got:
        t = by[r["doc_id"], r["n_tokens"]]
        ws = tokens(t)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert r["n_known"] == sum(plain.raw[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.raw[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(plain.score(t), rel=1e-5)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("a b a c. b a a",), ("c a b b d",), (None,)], "text string")
    model = kn.train(df, order=3, shards=3)
    reader, words = kn.Reader(model), ["a", "b", "c.", "c", "d"]
    h = np.array([next(kn.words(kn.pa.array([w]))).hashes[0] for w in words] + [kn.END, np.uint64(12345)], np.uint64)
    for context in ([h[0], h[1]], [h[2], h[0]], [kn.BEGIN, kn.BEGIN], [np.uint64(1), h[0]], [np.uint64(1), np.uint64(2)]):
        p = reader.probabilities([np.full(len(h), context[0]), np.full(len(h), context[1]), h])
        assert p.sum() == pytest.approx(1.0, abs=1e-5) and (p > 0).all()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    cols = [np.sort(rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2)), rng.integers(0, 9, 50).astype(np.uint64)]
    counts = rng.integers(1, 2**40, 50)
    back, n = kn.unpack(kn.pack(cols, counts))
    assert (n == counts).all() and all((a == b).all() for a, b in zip(cols, back))
    assert len(kn.unpack(kn.pack([c[:0] for c in cols], counts[:0]))[1]) == 0


def test_empty_corpus(spark):
    df = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    model = kn.train(df.limit(0))
    (row,) = kn.score(df, model).collect()
    assert row["score"] == 0 and row["base_score"] == 0 and row["n_known"] == 0
    assert kn.score(df.limit(0), model).count() == 0


def test_query(spark, sf):
    rows = registry.QUERIES["op2_lm_scores"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_fetched_arrays_are_mapped_and_let_go(spark, tmp_path):
    """A model on a file system that can't be mapped gives the same values, whatever the bound of what is kept."""
    from pyarrow import fs as pafs

    texts = [f"a{k % 7} b{k % 11} c{k % 3} d{k}" for k in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kn.train(df, order=3, shards=7, uri=f"file://{tmp_path}/m")
    ((words_, off, _, _),) = kn.token_stream(__import__("pyarrow").array([" ".join(texts)]))
    cols = kn.grams(words_, off, 3)
    want = kn.Reader(model).probabilities(cols)
    for most in (1 << 30, 1):
        r = kn.Reader(model, most)
        r.fs_path = (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), f"{tmp_path}/m")
        assert (r.probabilities(cols) == want).all() and (most > 1 or r.fetched < 100_000)


def test_shards_follow_the_input(spark, tmp_path, monkeypatch):
    """As many shards as shuffle partitions at least, else one for each SHARD_BYTES of files."""
    monkeypatch.setattr(kn, "SHARD_BYTES", 1000)
    df = spark.range(20_000).selectExpr("uuid() AS text")
    assert kn.shards_for(spark.createDataFrame([("a",)], "text string")) >= 4
    df.write.parquet(f"file://{tmp_path}/t")
    n = kn.shards_for(spark.read.parquet(f"file://{tmp_path}/t"))
    assert n > 100 and kn.shards_for(spark.read.parquet(f"file://{tmp_path}/t").filter("text <> ''")) <= n
