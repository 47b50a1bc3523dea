import random
import re

import pyarrow as pa
import pytest
from larkspan.llm import substrings
from larkspan.llm.textkernel import words
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, h string, i int, _x int"


def split(text, long=12):
    """Sentences as lists of (word, start, end) by a plain loop; byte offsets."""
    raw = text.encode()
    found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    out, now = [], []
    for k, w in enumerate(found):
        now.append(w)
        gap = raw[w[2] : found[k + 1][1]] if k + 1 < len(found) else b"\n"
        if w[0][-1:] in b".!?" or b"\n" in gap:
            out.append(now)
            now = []
    hashed = {w[0]: h for g in words(pa.array([text])) for w, h in zip(found, g.hashes.tolist())}
    fine = []
    for s in out:
        if len(s) <= long:
            fine.append(s)
            continue
        now = []
        for k, w in enumerate(s):
            now.append(w)
            capital = k + 1 < len(s) and raw[s[k + 1][1] : s[k + 1][2]].decode()[0]
            if hashed[w[0]] % 3 == 0 or (capital and capital.isupper()):
                fine.append(now)
                now = []
        fine += [now] if now else []
    return fine


def brute(docs, least_s=2, least_w=36):
    runs = {}
    parts = {d: split(t) for d, t in docs if d is not None and t is not None}
    for d, ss in sorted(parts.items()):
        got = set()
        for i in range(len(ss)):
            for j in range(i + least_s - 1, len(ss)):
                if sum(map(len, ss[i : j + 1])) >= least_w:
                    got.add((i, j))
                    break
        for j in range(len(ss)):
            for i in range(j - least_s + 1, -1, -1):
                if sum(map(len, ss[i : j + 1])) >= least_w:
                    got.add((i, j))
                    break
        for i, j in sorted(got):
            runs.setdefault(tuple(w[0] for s in ss[i : j + 1] for w in s), []).append((d, i, j))
    gone = {}
    for places in runs.values():
        first = min(p[:2] for p in places)
        for d, i, j in places:
            if (d, i) != first:
                gone.setdefault(d, set()).update(range(i, j + 1))
    out = []
    for d, t in docs:
        if d not in gone or t is None:
            out.append((d, t, 0))
            continue
        raw, ss = t.encode(), parts[d]
        edges = [s[0][1] for s in ss] + [len(raw)]
        kept = [k for k in range(len(ss)) if k not in gone[d]]
        text = (raw[: edges[0]] + b"".join(raw[edges[k] : edges[k + 1]] for k in kept)).decode() if kept else ""
        out.append((d, text, len(gone[d])))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["_cut"]["sentences_removed"]) for r in substrings.dedup_substrings(df).collect()), key=str)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500").select("doc_id", "text")
    got = result(docs)
    assert got == brute([tuple(r) for r in docs.collect()]) and sum(r[2] for r in got) > 100


def word(rng):
    return "".join(rng.choices("abcdefghij", k=7))


def marked(rng, n):
    """Sentences of 3 to 30 words with a capital and an end mark, n words in all."""
    out = []
    while len(out) < n:
        k = min(rng.randint(3, 30), n - len(out))
        s = [word(rng) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:]][:k]
        out[-1] += "."
    return out


def unmarked(rng, n):
    return [word(rng) for _ in range(n)]


@pytest.mark.parametrize("kind, least_words, least_found", [(marked, 0.97, 0.99), (unmarked, 0.88, 0.93)])
def test_passages_inserted_anywhere_go_and_clean_text_stays(spark, kind, least_words, least_found):
    """Passages of 51-60 words at random places of other texts: share of their words that goes, and of places that are found."""
    rng = random.Random(4)
    docs, planted = [], {}
    for p in range(60):
        passage = kind(rng, rng.randint(51, 60))
        for copy in range(3):
            d, host = 10 * p + copy, marked(rng, rng.randint(80, 300))
            at = rng.randint(0, len(host))
            docs.append((d, " ".join(host[:at] + passage + host[at:])))
            planted[d] = (copy, passage, host)
        docs.append((10 * p + 5, " ".join(marked(rng, 200))))
    got = {d: t for d, t, _ in result(spark.createDataFrame(docs, "doc_id long, text string"))}
    gone, found, total, over, clean = 0, 0, 0, 0, 0
    for d, t in docs:
        if d not in planted or planted[d][0] == 0:
            clean += got[d] == t
            continue
        left = set(got[d].split())
        lost = sum(w not in left for w in planted[d][1])
        gone, found, total = gone + lost, found + (lost > 0), total + len(planted[d][1])
        over += sum(w not in left for w in planted[d][2])
    assert clean == 120 and over == 0
    assert gone >= least_words * total and found >= least_found * 120, (gone / total, found / 120)


def test_short_repeats_stay(spark):
    """Lines and items of under 36 words are no passages."""
    rng = random.Random(5)
    line = " ".join(marked(rng, 34))
    docs = [(k, " ".join([*marked(rng, 60), line, *marked(rng, 60)])) for k in range(20)]
    got = {d: t for d, t, _ in result(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert got == dict(docs)


def test_odd_rows(spark):
    s = "One two three four five six seven eight nine. Ten eleven twelve thirteen fourteen fifteen sixteen é. And one more of these. " * 2 + "tail words here that are new"
    s = " ".join(f"{w}{k}" if w[-1] != "." else w for k, w in enumerate(s.split()))
    docs = [(4, s), (2, s.upper() + "\n\n" + s), (5, None), (6, ""), (None, s), (7, " \n "), (8, "x\n" * 700_000), (9, s), (9, s), (10, "short. one.")]
    df = spark.createDataFrame([(*d, "h", 1, 2) for d in docs], DOCS)
    out = substrings.dedup_substrings(df)
    assert out.columns[:-1] == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(docs)
    assert (None, s) in got and (5, None) in got and (6, "") in got and (7, " \n ") in got and (10, "short. one.") in got
    by = {d: t for d, t in got}
    assert by[4] == by[9] and "eleven10" not in by[4] and by[2].startswith(s.upper()) and len(by[8]) < 120
    assert substrings.dedup_substrings(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", F.lit(1).alias("_cut"), F.lit(2).alias("_cut_ID"), F.lit(3).alias("_cut_spans"), F.lit(4).alias("origin"), F.lit(5).alias("again"))
    out = substrings.dedup_substrings(clash)
    assert out.columns == [*clash.columns, "_cut_"] and {tuple(r)[2:7] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(d), str(t)) for d, t in got)
