import random

import corpus_pipeline
import numpy as np
import pytest
from test_simhash import classes

from textloom.llm import jaccard


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def least_ids(rows):
    items = [(i, shingles(r[1])) for i, r in enumerate(rows)]
    groups = {}
    for r, c in zip(rows, classes(items, similar)):
        groups.setdefault(c, []).append(r[0])
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)


def edited(seed=3):
    """Texts with copies of them in which a few words are others (0.6 to 1 similar), chains, a hot passage and one-word appendices."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, out = [word() for _ in range(60)], []
    for _ in range(25):
        words = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(5):
            out.append(" ".join(words))
            words = [word() if rng.random() < 0.012 else w for w in words]
    out += [" ".join(passage + [word() for _ in range(rng.randrange(0, 30))]) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(2))
def test_every_similar_pair_is_linked(make, rows_of, seed):
    rows = edited(seed)
    assert [k[0] for k in sorted(rows_of(jaccard.one_of_each(make(rows)), "doc_id"))] == sorted(least_ids(rows))


def test_a_passage_that_all_texts_share(make, rows_of, monkeypatch):
    """A hot shingle whose sets are lined up in parts, and of which few pairs are similar enough."""
    monkeypatch.setattr(jaccard, "LINED_UP", 20)
    monkeypatch.setattr(jaccard, "FEW", 5)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(100)]
    own = lambda: rng.choice([13, 13, 13, 9, 11, 12, 20, 2])
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(own()))])) for i in range(200)]
    assert [k[0] for k in sorted(rows_of(jaccard.one_of_each(make(rows)), "doc_id"))] == sorted(least_ids(rows))


@pytest.mark.parametrize("few", [2, 40])
def test_pairs_that_sizes_rule_out_are_not_made(spark, monkeypatch, few):
    """Sets of one size whose common shingles come too late: no row answers. With a larger place for one pair, that pair is met."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = [(7, node, 109, 13, node) for node in range(60)]
    schema = "h long, node long, n int, i int, root long"
    assert jaccard._crossing(spark.createDataFrame(rows, schema), 80).collect() == []
    rows += [(8, 3, 109, 2, 3), (8, 5, 100, 4, 5), (8, 6, 109, 13, 6), (9, 10, 50, 0, 10), (9, 11, 50, 0, 10)]
    assert {tuple(r) for r in jaccard._crossing(spark.createDataFrame(rows, schema), 80).collect()} == {(3, 5), (5, 6)}


def test_odd_rows(make, corpus, rows_of):
    left = jaccard.one_of_each(make(corpus))
    assert left.columns == make(corpus).columns
    assert sorted((k[0] for k in rows_of(left, "doc_id")), key=repr) == least_ids(list(dict.fromkeys((r[0], r[1]) for r in corpus)))
    assert rows_of(jaccard.one_of_each(make([]))) == []


def test_stage_reaches_similarity_08(spark, make, rows_of):
    """A copy with one word of a hundred changed is 0.9 similar, and SimHash fingerprints are more than 3 bits apart."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join(words[:70] + [f"v{i}" for i in range(30)]))]
    assert rows_of(corpus_pipeline.near_dedup(spark, make(rows), ""), "doc_id") == [(1,), (3,)]


def test_sets_that_share_half_a_hash_stay_apart(spark):
    prints = spark.createDataFrame([(b"x", 5, 1), (b"y", 5, 2), (b"z", 5, 2), (b"w", 6, 1)], "doc_id binary, node long, check long")
    nodes = {bytes(r.doc_id): r.node for r in jaccard._apart(prints).collect()}
    assert nodes[b"y"] == nodes[b"z"] != nodes[b"x"] == 5 and nodes[b"w"] == 6


def test_no_similar_pair_is_excluded(spark):
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, rng.choice([300, 4000])))], np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * q)], np.array([rng.getrandbits(64) for _ in range(int(len(s) * (1 - q)))], np.uint64)])) for s in sets for q in (0.5, 0.88, 0.9, 0.95)]
    prints = spark.createDataFrame([(i, jaccard._sketch(s) if i % 7 else None) for i, s in enumerate(sets)], "node long, sketch binary")
    every = [(i, j) for i in range(len(sets)) for j in range(i)]
    left = {(r.a, r.b) for r in jaccard._not_excluded(spark.createDataFrame(every, "a long, b long"), prints, 80).collect()}
    alike = {(i, j) for i, j in every if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert alike and alike <= left and len(left) < len(every) / 2
