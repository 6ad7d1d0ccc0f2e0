import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import periodic


def plain_runs(words, least=24, power=3):
    """All maximal stretches with smallest period q and at least max(least, power * q) words, by looking at each period."""
    out, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size, stretch = j - i + q, words[i : j + q]
            smaller = any(stretch[d:] == stretch[:-d] for d in range(1, q))
            if j > i and size >= max(least, power * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_audit(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def repetitive(rng, n):
    """Words of a small or large vocabulary, over which a few periodic stretches are written."""
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        for i in range(a, rng.randrange(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least,power", [(24, 3), (6, 2), (2, 2), (9, 3)])
def test_runs_of_several_texts_at_once(least, power):
    rng = random.Random(least)
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 24, 30, 60, 150])) for _ in range(rng.randrange(1, 6))]
        first = np.cumsum([0] + [len(t) for t in texts])
        hashes = (np.array([w for t in texts for w in t], np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        want = [(a + int(f), n, q) for f, t in zip(first, texts) for a, n, q in plain_runs(t, least, power)]
        assert list(zip(*(x.tolist() for x in periodic.word_runs(hashes, first, least, power)))) == want


def test_long_periods():
    """Periods of thousands of words, a word alone, and a Fibonacci word, whose runs are of all sizes."""
    unit = list(range(4000))
    a, b = "x", "xy"
    while len(b) < 700:
        a, b = b, b + a
    for words in (unit * 3 + unit[:5], [7] * 5000, [ord(c) for c in b]):
        hashes = (np.array(words, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        got = list(zip(*(x.tolist() for x in periodic.word_runs(hashes, np.array([0, len(words)])))))
        assert got == (plain_runs(words) if len(words) < 1000 else [(0, len(words), 4000 if words[0] == 0 else 1)])


def test_digests(spark, make, corpus, rows_of):
    rng = random.Random(4)
    rows = corpus + [(1000 + i, " ".join(f"w{w}" for w in repetitive(rng, rng.randrange(0, 400)))) for i in range(60)]
    rows = [(r[0], r[1]) for r in rows if len(r[1] or "") < 30_000]
    got = rows_of(periodic.audited(periodic.collapse_runs(periodic.with_planted_periods(make(rows)))))
    want = sorted((plain_audit(i, t) for i, t in rows), key=repr)
    assert got == want and sum(r[1] > 0 for r in want) > 10


def test_operator_keeps_texts_and_places(make, rows_of):
    phrase = "one two three four "
    docs = make([(1, "start " + phrase * 9 + "end"), (2, None), (3, " \n "), (4, "no run here"), (4, "no run here")])
    got = rows_of(periodic.collapse_runs(docs).selectExpr("doc_id", "size(runs) n", "strongest.start s", "strongest.length l", "strongest.period p", "collapsed"))
    assert got == [(1, 1, 1, 36, 4, "start one two three four end"), (2, 0, None, None, None, ""), (3, 0, None, None, None, ""), (4, 0, None, None, None, "no run here"), (4, 0, None, None, None, "no run here")]
    assert rows_of(periodic.collapse_runs(make([]))) == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, power=1)


def test_very_long_text(make, rows_of):
    rng = random.Random(1)
    head, unit = [f"w{rng.randrange(10**6)}" for _ in range(60_000)], [f"v{i}" for i in range(9000)]
    got = periodic.collapse_runs(make([(1, " ".join(head + unit * 4))])).selectExpr("strongest.start s", "strongest.length l", "strongest.period p", "length(collapsed) n")
    assert rows_of(got) == [(60_000, 36_000, 9000, len(" ".join(head + unit)))]
