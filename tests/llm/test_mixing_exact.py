"""The exact programme leaves no length out, however few sums may be held."""

import random
import tracemalloc

import numpy as np
import pytest
from larkspan.llm import mixing


def sums_of(lengths, counts):
    sums = {0}
    for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + size * k for s in sums for k in range(n + 1)}
    return sums


@pytest.mark.parametrize("cells", [1, 1 << 10, 1 << 29])
def test_exact_matches_brute_force(monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rng = random.Random(7)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(80), rng.randrange(1, 9))))
        counts = np.array([rng.randrange(6) for _ in lengths])
        budget = rng.randrange(1, 300)
        take = mixing.exact(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in sums_of(lengths, counts) if s <= budget)


def test_the_one_length_that_fits_is_not_left_out():
    lengths = np.sort(np.append(np.arange(1_000_000, 1_006_000, 4), 1_001_001))
    counts = np.ones(len(lengths), np.int64)
    take = mixing.exact(lengths, counts, 4_011_005)  # three multiples of four and the odd length
    assert int((take * lengths).sum()) == 4_011_005 and (take <= counts).all()
    assert int((mixing.fit(lengths, counts, 4_011_005) * lengths).sum()) == 4_011_005


def test_sums_held_are_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 1 << 24)
    lengths = np.concatenate([np.arange(20, 80) * 20_000, [20_001]])  # most sums can't be reached, so all steps are walked
    counts = np.full(len(lengths), 50)
    tracemalloc.start()
    take = mixing.exact(np.sort(lengths), counts, 3_999_999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((take * np.sort(lengths)).sum()) == 3_980_050 and peak < 24 * (4_000_000 // 8)


def test_longest_documents_beyond_two_to_the_24():
    take = mixing.fit(np.array([18_000_000, 19_000_000]), np.array([4, 4]), 54_000_000)
    assert take.tolist() == [3, 0]
