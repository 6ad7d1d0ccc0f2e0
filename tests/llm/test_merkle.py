import hashlib
from collections import Counter
from itertools import zip_longest

from textloom.llm import merkle


def plain(text):
    """The tree as nested lists of leaf texts: eight words a leaf, a line a paragraph, sections ended by a blank line or eight paragraphs."""
    sections = [[]]
    for line in text.split("\n"):
        if len(sections[-1]) == 8 or (sections[-1] and sections[-1][-1] == [""]):
            sections.append([])
        words = line.split(" ")
        sections[-1].append([" ".join(words[i : i + 8]) for i in range(0, len(words), 8)])
    return sections


def hashed(x, level=0):
    kind = ("root", "section", "paragraph", "leaf")[level].encode()
    return hashlib.blake2b(x.encode() if level == 3 else b"".join(hashed(c, level + 1) for c in x), digest_size=16, person=kind).digest()


def leaves(x):
    return [x] if isinstance(x, str) else [leaf for c in x for leaf in leaves(c)]


def apart(a, b):
    """The leaves of either side below the branches that aren't equal, by comparing what they hold."""
    if a == b:
        return [], []
    if isinstance(a, str) or isinstance(b, str):
        return leaves(a), leaves(b)
    both = [apart(x, y) if x is not None and y is not None else ([] if x is None else leaves(x), [] if y is None else leaves(y)) for x, y in zip_longest(a, b)]
    return [x for p in both for x in p[0]], [x for p in both for x in p[1]]


def likeness(a, b):
    if a == b:
        return 1.0
    weight = lambda xs: sum(len(x) + 1 for x in xs)
    left, right = apart(a, b)
    moved = list((Counter(left) & Counter(right)).elements())
    return min(1.0, 2.0 * (weight(leaves(a)) - weight(left) + weight(moved)) / (weight(leaves(a)) + weight(leaves(b))))


def brute_force(items):
    rows = sorted(((r[0], r[1] or "") for r in items), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, after, nxt = plain(text), plain(edited), plain(following)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hashed(own).hex(), hashed(after).hex(), likeness(own, after), likeness(own, nxt)))
    return sorted(want, key=repr)


def test_brute_force(make, corpus, rows_of):
    assert rows_of(merkle.compare_with_edits(make(corpus))) == brute_force(corpus)


def test_partitions_do_not_change_rows(spark, make, corpus, rows_of):
    """More partitions than ids, repeated and null ids in several of them, and no exchange used twice."""
    rows = corpus + [(None, f"{k} no id") for k in range(30)] + [(5, f"{k} five") for k in range(30)]
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.exchange.reuse": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert rows_of(merkle.compare_with_edits(make(rows))) == brute_force(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_roots_are_equal_texts(corpus):
    texts = {r[1] or "" for r in corpus} | {"a b", "a  b", "a\nb", "a\n\nb", "a b\n", " a b", ""}
    assert len({merkle.tree(t).digest for t in texts}) == len(texts)


def test_branches_locate_an_edit():
    lines = [f"line {i} with some words to fill more than one leaf of the tree" for i in range(100)]
    a = merkle.tree("\n".join(lines))
    lines[57] = lines[57].replace("some", "other")
    left, right = merkle.differing(a, merkle.tree("\n".join(lines)))
    assert len(left) == len(right) == 1 and merkle.likeness(a, merkle.tree("\n".join(lines))) > 0.98


def test_likeness_is_symmetric_and_low_for_others():
    a, b = merkle.tree("one two three four " * 20), merkle.tree("five six seven eight nine " * 20)
    assert merkle.likeness(a, b) == merkle.likeness(b, a) == 0 and merkle.likeness(a, a) == 1


def test_single_and_none(make, rows_of):
    (row,) = rows_of(merkle.compare_with_edits(make([(4, "ab cd ef")])), "doc_id", "near_next")
    assert row == (4, 1.0)
    assert rows_of(merkle.compare_with_edits(make([]))) == []
    assert rows_of(merkle.fingerprints(make([(1, None), (1, "")])), "n_chars") == [(0,), (0,)]
