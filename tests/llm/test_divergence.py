import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import divergence


def plain(rows, least_docs=10, best=10):
    """rows (text, lang, source); the definition, group by group, with Python's integers."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms = [(lang or "", source or "", [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    spread, groups = Counter(), defaultdict(Counter)
    for lang, source, found in terms:
        spread.update((lang, t) for t in set(found))
        groups[lang, source].update(found)
    out = []
    for (lang, source), own in groups.items():
        kept = [t for (x, t), n in spread.items() if x == lang and n >= least_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine, every = p(own), p(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        pairs = [(s, sum(f(mine[t], q[t]) for t in kept)) for (x, s), c in groups.items() if x == lang and s != source for q in [p(c)]]
        single = [(t, f(mine[t], every[t])) for t in kept if own[t] and mine[t] > every[t]]
        for part, items in (("pair", pairs), ("term", single)):
            items.sort(key=lambda i: (-i[1], i[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < best]
    return sorted(out, key=repr)


WORDS = "Alpha beta GAMMA delta été ÉTÉ größer 你好 naïve x y z the a_b c3d [e] \U0001f600 f".split()


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n long, docs long, term string, block int"
    return spark.createDataFrame([(i, *r, 1, 2, "t", 3) for i, r in enumerate(rows)], schema).repartition(3)


@pytest.mark.parametrize("cells", [1 << 19, 40])
def test_against_the_definition(spark, rows_of, monkeypatch, cells):
    """Also with so few cells to a block that a language has several."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = random.Random(cells)
    text = lambda: rng.choice([" ", "\n", ", "]).join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(0, 40)))
    rows = [(text(), rng.choice(["en", "en", "fr", "", None]), rng.choice(["s1", "s1", "s1", "s2", "S2", "", None, "é"])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), (None, "xx", None), ("rare words", "xx", "s9"), ("alone", "yy", "s1"), rows[0], rows[0], ("beta Beta " * 20_000, "fr", "s2")]
    got = rows_of(divergence.source_divergence(table(spark, rows)))
    want = plain(rows)
    assert got == want and {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)


def test_other_limits_and_an_empty_table(spark, rows_of):
    rows = [("b a a", "en", "x"), ("b c", "en", "y"), ("c c c", "en", "z")]
    assert rows_of(divergence.source_divergence(table(spark, rows), least_docs=1, best=2)) == plain(rows, 1, 2)
    assert rows_of(divergence.source_divergence(table(spark, []))) == []


def test_integers_beyond_64_bits():
    """10**9 times a count of 10**12 has 70 bits."""
    count, total = np.array([0, 5, 10**12, 4 * 10**15]), np.array([4 * 10**15 + 12])
    assert divergence.probability(count, total).tolist() == [1 + 10**9 * (c + 2) // int(total[0]) for c in count.tolist()]


def test_tiles_give_what_one_tile_gives(monkeypatch):
    p = np.random.default_rng(1).integers(1, 10**9, (23, 57))
    whole = divergence._pair_sums(p)
    monkeypatch.setattr(divergence, "TILE", 50)
    assert (divergence._pair_sums(p) == whole).all()
    assert whole[3, 8] == sum((a - b) ** 2 // (a + b) for a, b in zip(p[3].tolist(), p[8].tolist()))
