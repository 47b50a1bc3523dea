import random

from test_substrings import result, split


def whole(docs, least_s=2, least_w=36):
    """As brute() of test_substrings, with the shortest runs that end at each sentence beside those that begin there."""
    runs, parts = {}, {d: split(t) for d, t in docs}
    for d, ss in parts.items():
        n, got = [len(x) for x in ss], set()
        for k in range(len(ss)):
            ahead = next((j for j in range(k + least_s - 1, len(ss)) if sum(n[k : j + 1]) >= least_w), None)
            back = next((i for i in range(k - least_s + 1, -1, -1) if sum(n[i : k + 1]) >= least_w), None)
            got |= {(k, ahead)} if ahead is not None else set()
            got |= {(back, k)} if back is not None else set()
        for i, j in got:
            runs.setdefault(tuple(w[0] for s in ss[i : j + 1] for w in s), []).append((d, i, j))
    gone = {d: set() for d in parts}
    for places in runs.values():
        first = min(p[:2] for p in places)
        for d, i, j in places:
            if (d, i) != first:
                gone[d].update(range(i, j + 1))
    return {d: len(g) for d, g in gone.items()}


def prose(rng, n):
    out = []
    while len(out) < n:
        k = min(rng.randint(3, 12), n - len(out))
        out += ["".join(rng.choices("abcdefghij", k=7)) for _ in range(k)]
        out[-1] += "."
    return " ".join(out)


def test_last_sentences_of_a_passage_go(spark):
    lengths = (12, 12, 12, 12, 12, 3)
    rng = random.Random(1)
    passage = " ".join(" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n)) + "." for n in lengths)
    docs = [(1, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), (2, f"{prose(rng, 30)} {passage} {prose(rng, 30)}")]
    got = {d: t for d, t, _ in result(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert got[1] == docs[0][1] and not set(passage.split()) & set(got[2].split())


def test_exact_copies_are_emptied(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)]
    got = {d: t for d, t, _ in result(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert all(got[k] == t and got[100 + k] == "" for k, t in enumerate(texts))


def test_runs_from_and_up_to_each_sentence_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 200 AND text IS NOT NULL AND length(text) < 6000").select("doc_id", "text")
    got = {d: n for d, _, n in result(docs)}
    assert got == whole([tuple(r) for r in docs.collect()]) and sum(got.values()) > 50
