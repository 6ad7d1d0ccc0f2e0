import hashlib
import re

import pytest

from textloom.llm import substring


def expected(rows, window):
    """Every window against every earlier one."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))]
    seen, out = set(), []
    for doc_id, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 5])
def test_brute_force(make, corpus, rows_of, window):
    found = substring.remove_repeats(make(corpus), window)
    assert rows_of(found.drop("repeats")) == expected(corpus, window)


def test_many_chunks_and_buckets(make, corpus, rows_of, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 8000)
    monkeypatch.setattr(substring, "BUCKET_PROBES", 2000)
    assert rows_of(substring.remove_repeats(make(corpus)).drop("repeats")) == expected(corpus, 20)


def test_repeats_are_maximal_runs(make):
    a = " ".join(f"w{i}" for i in range(50))
    out = {r.doc_id: r.repeats for r in substring.remove_repeats(make([(1, a), (2, f"x y {a} z {a}")])).collect()}
    assert out[1] == [] and [(s.start, s.end) for s in out[2]] == [(2, 52), (53, 103)]


def test_empty_table(make, rows_of):
    assert rows_of(substring.remove_repeats(make([]))) == []
