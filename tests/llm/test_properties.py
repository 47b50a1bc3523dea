"""Properties that hold for any input, over generated cases."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import kneserney, media, mixing, warc
from larkspan.llm.textkernel import words

TEXT = st.text(alphabet="aB \t\né 中.", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
def test_words_are_those_of_python(texts):
    seen = {}
    for w in words(pa.array(texts, pa.string())):
        for r in range(w.first, w.last):
            got = w.hashes[w.offsets[r - w.first] : w.offsets[r - w.first + 1]].tolist()
            want = (texts[r] or "").encode().lower().split()
            assert len(got) == len(want)
            for h, x in zip(got, want):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=3), st.integers(0, 10**6)), max_size=8, unique_by=lambda x: x[0]))
def test_targets_share_the_budget(sizes):
    goal = mixing.targets(sizes)
    total = sum(n for _, n in sizes)
    assert all(g <= 2 * dict(sizes)[s] + 1e-6 for s, g in goal.items())
    assert abs(sum(goal.values()) - 1.5 * total) <= 1e-6 * max(1, total)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 3000), st.integers(1, 50), min_size=1, max_size=12), st.floats(0, 1))
def test_fit_stays_within_its_counts(counts, part):
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths.tolist()])
    take = mixing.fit(lengths, n, part * (lengths * n).sum())
    assert (take >= 0).all() and (take <= n).all()
    assert abs((take * lengths).sum() - part * (lengths * n).sum()) <= lengths.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3), st.integers(1, 2**40)), max_size=30))
def test_blocks_hold_what_was_packed(rows):
    rows.sort()
    cols = [np.array([r[k] for r in rows], np.uint64) for k in (0, 1)]
    counts = np.array([r[2] for r in rows], np.int64)
    back, n = kneserney.unpack(kneserney.pack(cols, counts))
    assert n.tolist() == counts.tolist() and [b.tolist() for b in back] == [c.tolist() for c in cols]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 9), st.sampled_from(media.FORMATS))
def test_images_round_trip(data, width, form):
    depth = 1 if form in ("pgm", "bmp8") else 3
    row = width * depth
    flat = np.frombuffer(data.ljust(row, b"\0")[: max(1, len(data) // row) * row], np.uint8)
    img = flat.reshape(-1, width) if depth == 1 else flat.reshape(-1, width, 3)
    assert (media.decode(media.encode(img, form)) == img).all()


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 5)), st.text(max_size=20), st.binary(max_size=200))
def test_warc_records_parse_back(page, url, payload):
    fields, body = warc.parse(warc.record(page, url, payload, None))
    assert body == payload and fields.get("x-page-id") == (None if page is None else str(page))
    split = warc.Splitter()
    assert list(split.feed(warc.record(page, url, payload, 3) * 2)) == [warc.record(page, url, payload, 3)] * 2
    split.close()
