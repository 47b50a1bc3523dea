import itertools
import random

import numpy as np
from larkspan.llm import mixing


def test_few_long_documents_fit_exactly():
    take = mixing.fit(np.array([50_000, 60_000]), np.array([3, 3]), 150_000)
    assert take.tolist() == [3, 0]


def test_few_long_documents_match_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(20_000, 90_000), 3)))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(40_000, min(int((lengths * counts).sum()), 4 * int(lengths[-1])))
        got = int((mixing.fit(lengths, counts, budget) * lengths).sum())
        sums = [int(np.dot(c, lengths)) for c in itertools.product(*(range(n + 1) for n in counts))]
        assert abs(got - budget) <= budget - max(x for x in sums if x <= budget)


def test_many_long_lengths_stay_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 1 << 26)
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(30_000, 90_000, 2000))
    counts = rng.integers(1, 9, len(lengths))
    for part in (0.002, 0.3, 0.9):
        budget = int(part * (lengths * counts).sum())
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= 1
