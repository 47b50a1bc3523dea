"""Operators that treat each row alone: licences, languages, media, chats."""

import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from larkspan.llm import chat, language, licences, media, registry
from larkspan.llm.textkernel import WINDOW, shingles, words, words_of
import pyarrow as pa

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, component_id string"
ODD = [
    (1, None, None, None, None, 7, "x"),
    (2, "", "en", "s", 0, 7, "x"),
    (3, "...  \t\n", "en", "s", 0, None, None),
    (None, "MIT License, mit-license; the General  Public\nLICENSE. é", None, "s", 1, 1, "y"),
    (5, "Released under the MIT License.", "en", None, 1, 1, "y"),
    (5, "Released under the MIT License.", "en", None, 1, 1, "y"),
    (6, "This work is licensed under the GNU General Public License, version 3 and the Apache License", "en", None, 1, 1, "y"),
    (7, "x " * 700_000 + "apache license " + "y" * 1_200_000 + " mit license", "en", "s", 1, 1, "y"),
]


def base_by_regex(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(ws), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_match_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ODD, DOCS)
    for df in (docs, odd):
        want = sorted((((r["doc_id"] is None, r["doc_id"] or 0), *base_by_regex(r["text"])) for r in df.collect()), key=str)
        out = licences.scan_licences(df).collect()
        got = sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str)
        assert got == want
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    labels = {r["doc_id"]: r["labels"] for r in licences.scan_licences(odd).collect()}
    assert labels[6] == "apache,gpl,gpl-3.0" and labels[5] == "mit,mit-notice" and labels[2] == ""


def test_licences_in_pieces_agree_with_one_piece(monkeypatch):
    index = licences.Index((*licences.BASE, *licences.NOTICES), {}, 10)
    text = b" ".join([b"released under the mit license", b"z" * 50, b"licensed under the apache license version 2 0 general public license"] * 40)
    whole = licences.scan_text(text, index)
    for size in (40, 64, 300, 1000):
        monkeypatch.setattr(licences, "PIECE", size)
        assert licences.scan_text(text, index) == whole


def test_licences_empty_table(spark):
    assert licences.scan_licences(spark.createDataFrame([], DOCS)).count() == 0


def test_words_and_shingles_match_python():
    texts = ["A b\tC d e f", "a B c D e", "", None, "one", "é È é", "x" * 10 + " " + "y" * 3, "b c d e f"]
    w = list(words(pa.array(texts)))
    assert [g.last for g in w][-1] == len(texts)
    g = w[0]
    got = [g.hashes[g.offsets[i] : g.offsets[i + 1]].tolist() for i in range(len(texts))]
    split = [(t or "").encode().lower().split() for t in texts]
    assert [len(x) for x in got] == [len(x) for x in split]
    by = {}
    for hs, ws in zip(got, split):
        for h, x in zip(hs, ws):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    s, o = shingles(g.hashes, g.offsets)
    assert np.diff(o).tolist() == [2, 1, 0, 0, 1, 1, 1, 1]
    assert s[o[0]] == s[o[1]] and s[o[0] + 1] == s[o[7]]


def test_long_texts_hash_as_short_ones():
    word = "w" * (WINDOW + 5)
    text = "alpha beta " * (WINDOW // 8) + word + " gamma " + word
    h = words_of(text)
    assert len(h) == 2 * (WINDOW // 8) + 3 and h[-1] == h[-3]
    assert h[0] == words_of("alpha")[0] and h[-2] == words_of("gamma")[0]


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    odd = language.identify(spark.createDataFrame(ODD, DOCS), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= r["score"] <= 1 for r in odd) and len(odd) == len(ODD)
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert language.identify(docs, language.train(empty)).filter("lang_pred <> 'und'").count() == 0


def ppm_bits(text, counts, order):
    """Code length by definition, one byte at a time."""
    data, total = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()), 0.0
    for i, b in enumerate(data):
        for size in range(min(order, i), -2, -1):
            if size < 0:
                total += 8.0
                break
            seen = counts.get(data[i - size : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b in seen:
                total -= np.log2(seen[b] / (n + d))
                break
            total -= np.log2(d / (n + d))
    return total


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_match_definition(order):
    train = {"a": ["the cat sat on the mat", "a cat"], "b": ["le chat est là", "x"]}
    model = language.Model({k: language.count_contexts(v, order, held=7) for k, v in train.items()}, order)
    trees = {}
    for k, texts in train.items():
        tree = trees[k] = {}
        for t in texts:
            data = t.encode()
            for i, b in enumerate(data):
                for size in range(0, min(order, i) + 1):
                    node = tree.setdefault(data[i - size : i], {})
                    node[b] = node.get(b, 0) + 1
    texts = ["The cat", "", "zzz quâ", "le mat chat", "t"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = model.lengths(data, bounds)
    want = [[ppm_bits(t, trees[k], order) for k in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-4)
    old, language.WINDOW = language.WINDOW, 5
    try:
        assert np.allclose(model.lengths(data, bounds), want, rtol=1e-4)
    finally:
        language.WINDOW = old


@pytest.mark.parametrize("form", media.FORMATS)
def test_media_round_trip(form):
    rng = np.random.default_rng(1)
    for n in (576, 576 * 7):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.decode(media.store(payload, form)).tobytes() == payload
    img = rng.integers(0, 256, (5, 7) if form in ("pgm", "bmp8") else (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode(img, form)) == img).all()


def test_media_text_and_bit_formats():
    assert media.decode(b"P2 # note\n2 2 255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_matches_definition(monkeypatch):
    rng = np.random.default_rng(2)
    for shape, out in (((24, 24), (8, 9)), ((10, 7), (3, 4)), ((3, 3), (7, 5)), ((50, 24), (16, 16))):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        fine = np.kron(img, np.ones((out[0], out[1])))  # each output box is whole here
        want = fine.reshape(out[0], shape[0], out[1], shape[1]).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(img, *out), want)
        monkeypatch.setattr(media, "BAND_ROWS", 4)
        assert np.allclose(media.area_resize(img, *out), want)
        monkeypatch.undo()


def test_media_query(spark, tmp_path):
    df = spark.createDataFrame(ODD[:6], DOCS)
    rows = media.text_images(df, keep_media=True).collect()
    assert len(rows) == 6
    texts = {r[0]: r[1] or "" for r in ODD[:6]}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert media.decode(bytes(r["media"])).tobytes() == payload and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert np.load(io.BytesIO(r["tile_npy"])).shape == (16, 16)
    for r in media.text_images(df, uri=f"file://{tmp_path}/tiles").collect():
        stack = np.load(tmp_path / "tiles" / r["tile_file"])
        luma = media.grey(media.decode(media.store(payload_of(texts[r["doc_id"]]))))
        assert stack.shape[1:] == (16, 16) and (stack[r["tile_at"]] == np.load(io.BytesIO(r["tile_npy"]))).all()
        assert (stack[r["tile_at"]] == np.rint(media.area_resize(luma, 16, 16))).all()
    assert media.text_images(df.limit(0), uri=f"file://{tmp_path}/none").count() == 0


def payload_of(text):
    raw = text.encode()
    return raw + b"\xff" * (576 if not raw else -len(raw) % 576)


def test_difference_hash_matches_definition():
    rng = np.random.default_rng(5)
    for shape in ((16, 18), (24, 24), (7, 40)):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        fine = np.kron(img, np.ones((8, 9))).reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3))
        bits = "".join("1" if fine[y, x + 1] > fine[y, x] + 1e-9 else "0" for y in range(8) for x in range(8))
        assert media.difference_hash(img) == f"{int(bits, 2):016x}"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be # <nice>"),
        (1, 1, "user", "a\\b </turn>\n### Assistant: x"),
        (1, 2, "assistant", "é\\"),
        (2, 1, "assistant", None),
        (2, 0, "User", "role like a title"),
        (2, 1, "a: b", ""),
        (3, None, None, "q"),
        (3, 0, "user", "q"),
        (3, 0, "user", "q"),
        (None, 0, "user", "u"),
        (None, 1, "assistant", "v" * 200_000),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("*", chat.parse_chats(out["formatted"]).alias("turns")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert sum(s["loss"] for s in got[c]["segments"]) == sum(r == "assistant" for r, _ in want)
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and got[None]["valid"]
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_runs_the_machine(spark, sf):
    """The states of the role machine are in the optimised plan and in the rows."""
    from larkspan.llm.registry import op8_chat_format

    out = op8_chat_format(spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "answered" in plan and "broken" in plan and "aggregate(" in plan
    rows = {r["conv_id"]: r for r in out.collect()}
    assert rows[-7]["valid"] and rows[-7]["end_state"] == "answered"
    assert all(r["valid"] == (r["end_state"] == "answered") for r in rows.values())


def test_queries_keep_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_licence_scan", "op9_language_id", "op10_media_columns"):
        assert registry.QUERIES[name](spark, sf).count() == n
