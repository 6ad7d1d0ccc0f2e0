import random

import numpy as np
import pytest
from test_simhash import classes

from textloom.llm import chosen_path


def bigrams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def similar(a, b):
    return bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)


def plain(rows):
    sets = [bigrams(r[1]) for r in rows]
    groups = classes([(i, s) for i, s in enumerate(sets)], similar)
    least = {}
    for r, c in zip(rows, groups):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    return sorted(((r[0], len(s), least[c], r[0] == least[c]) for r, s, c in zip(rows, sets, groups)), key=repr)


def edited(seed, n=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, out = [word() for _ in range(60)], []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(2, 200))]
        for _ in range(5):
            out.append(" ".join(words))
            words = [word() if rng.random() < 0.04 else w for w in words]
    out += [" ".join(passage + [word() for _ in range(rng.randrange(0, 20))]) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(2))
def test_every_similar_pair_is_linked(make, rows_of, seed):
    rows = edited(seed)
    assert rows_of(chosen_path.near_duplicates(make(rows))) == plain(rows)


def test_large_nodes(make, rows_of, monkeypatch):
    """Nodes with two sets apart branch again, those of the greatest length are compared in blocks, and texts are dealt out."""
    monkeypatch.setattr(chosen_path, "SMALL", 1)
    monkeypatch.setattr(chosen_path, "BLOCK", 2)
    monkeypatch.setattr(chosen_path, "LAST", 3)
    monkeypatch.setattr(chosen_path, "SENT", 0)
    rows = edited(5, 12)
    assert rows_of(chosen_path.near_duplicates(make(rows))) == plain(rows)


def test_odd_rows(make, corpus, rows_of):
    assert rows_of(chosen_path.near_duplicates(make(corpus))) == plain([(r[0], r[1]) for r in corpus])
    assert rows_of(chosen_path.near_duplicates(make([]))) == []
    with pytest.raises(ValueError):
        chosen_path.near_duplicates(make([]), above=49)


def test_minwise_values_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for similarity in (0.5, 0.8, 0.95):
        rates, bits = [], []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            common = int(600 * 2 * similarity / (1 + similarity))
            y = np.concatenate([x[:common], rng.integers(0, 1 << 63, 600 - common).astype(np.uint64)])
            a, b = (chosen_path.minwise(s) for s in (x, y))
            rates.append((a == b).mean())
            p, q = (chosen_path._bits(v[None, :]) for v in (a, b))
            bits.append(np.bitwise_count(p.view(np.uint64) ^ q.view(np.uint64)).sum() / chosen_path.VALUES)
        assert abs(np.mean(rates) - similarity) < 0.03 and abs(np.mean(bits) - (1 - similarity) / 2) < 0.03


def test_recall_of_the_trees():
    """Pairs of the least similarity that links: the share that all trees miss down to the greatest length, from the share of one tree."""
    rng = np.random.default_rng(3)
    missed, pairs = 0, 300
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, 450).astype(np.uint64)
        y = np.concatenate([x[:400], rng.integers(0, 1 << 63, 50).astype(np.uint64)])  # 400 of 500
        values = np.stack([chosen_path.minwise(s) for s in (x, y)])
        ends = []
        for k in (0, 1):
            paths = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rows, tree = np.full(100, k), np.arange(100)
            for _ in range(chosen_path.LAST):
                before = paths
                paths, rows = chosen_path._children(paths, rows, values, 0.25)
                del before
            ends.append(set(paths.tolist()))
        missed += len(ends[0] & ends[1]) < 5
    assert missed / pairs < 0.05


def test_sets_link_with_the_closest_by_parities(spark):
    """Heads whose bits are alike but whose shingles differ don't take the places of one that is similar."""
    from textloom.llm import chosen_path

    clean, far = [0] * 16, [-1] * 16
    # A set in eight nodes, each of which has one other set: seven are far in shingles and equal in bits, one is the other way round.
    others = [(10 + k, 100, 0 if k < 7 else 1, far if k < 7 else clean) for k in range(8)]
    schema = "path long, node long, n int, s long, t long, root long"
    members = spark.createDataFrame([row for k, (node, n, s, _) in enumerate(others) for row in ((k, node, n, s, 0, node), (k, 1, 100, 0, 0, 1))], schema)
    sets = spark.createDataFrame([(1, clean), *((node, odd) for node, _, _, odd in others)], "node long, odd array<long>")
    # Whichever set a node has picked, pairs are of it and the other one.
    assert {(r.a, r.b) for r in chosen_path._stars(members, sets, 80).collect()} <= {(1, 17)}
    heads = members.filter("node = 17 OR node = 1")
    assert {(r.a, r.b) for r in chosen_path._stars(heads, sets, 80).collect()} <= {(1, 17)}
    assert (1, 17) in {(r.a, r.b) for r in chosen_path._stars(members, sets, 80).collect()}
