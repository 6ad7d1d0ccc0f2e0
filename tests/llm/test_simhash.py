import itertools
import random

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash
from textloom.llm._components import components


def fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """The smallest id that each (id, value) reaches, over all pairs."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i][1], items[j][1]):
            root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            ids[find(i)] = min(ids.get(find(i), key), key)
    return [ids.get(find(i)) for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


def expected(rows, k=3):
    items = [(r[0], fingerprint(r[1], k)) for r in rows]
    return sorted(((i, f"{f:016x}", c) for (i, f), c in zip(items, classes(items, near))), key=repr)


def test_brute_force(make, corpus, rows_of):
    assert rows_of(simhash.near_duplicates(make(corpus))) == expected(corpus)


def planted(n, seed):
    """Random fingerprints, each with others up to 4 bits away, in chains, and clusters around one."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            out.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
    centre = rng.getrandbits(64)
    out |= {centre ^ (1 << b) for b in range(0, 64, 3)} | {centre ^ (3 << b) for b in range(40)}
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_no_link_is_lost(spark, seed):
    fps = planted(300, seed)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3))
    assert all(near(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(found.get(s, ("alone", s)), set()).add(f)
    want = {}
    for f, c in zip(fps, classes([(f, f) for f in fps], near)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_covering_meets_all_close_pairs(distance):
    rng = random.Random(distance)
    c = simhash.Covering(distance)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), distance))
        anchors, home = [], []
        for v in (x, y):
            _, found, homes = c.anchors(np.array([v], np.uint64))
            anchors.append(set(found.tolist()))
            home.append(set(found[homes].tolist()))
        assert home[0] & anchors[1] and home[1] & anchors[0]


def test_components_of_a_long_chain_and_a_star(spark, rows_of):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    found = {}
    for node, root in rows_of(components(spark.createDataFrame(links, "a long, b long"))):
        found.setdefault(root, set()).add(node)
    assert sorted(map(min, found.values())) == [0, 1000] and sorted(map(len, found.values())) == [301, 400]


def test_empty_table(make, rows_of):
    assert rows_of(simhash.near_duplicates(make([]))) == []
