"""Edit distances of many pairs, moves of blocks and sums of n-grams against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from textloom.operators import edits, metrics


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


@pytest.fixture(scope="module")
def found():
    rng, out = random.Random(1), []
    for _ in range(600):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(rng.choice([5, 30, 150])))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randrange(100))]
        out.append((a, b) if rng.random() < 0.5 else (b, a))
    return out


@pytest.mark.parametrize("few", [0, 5, 64])
def test_distances(found, few):
    lists = metrics._word_lists([a for a, _ in found], [b for _, b in found])
    assert edits.distances(*lists, few).tolist() == [plain(a, b) for a, b in found]
    nothing = np.zeros(0, np.int64)
    assert edits.distances(nothing, nothing, nothing, nothing).tolist() == []


def test_a_block_is_moved_with_few_distances(monkeypatch):
    """The best move of fifty words is found by way of what a move can save: ten in place of some 480 distances."""
    calls = []
    monkeypatch.setattr(metrics, "edit_distance", lambda a, b: calls.append(1) or edits.edit_distance(a, b))
    ref = [f"w{i}" for i in range(50)]
    assert metrics.shifted_edits(ref[-2:] + ref[:-2], ref) == 1
    assert len(calls) < 10


@pytest.mark.parametrize("referred", [False, True])
def test_gram_sums(found, referred):
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    sums = metrics._gram_sums(*metrics._word_lists([a for a, _ in found], [b for _, b in found]), 6, referred)
    for n in range(1, 7):
        both = [(grams(a, n), grams(b, n)) for a, b in found]
        assert sums[n - 1].tolist() == [sum((a & b).total() for a, b in both), sum(a.total() for a, b in both if b or not referred), sum(b.total() for _, b in both)]
