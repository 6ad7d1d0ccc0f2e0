"""Metrics against plain restatements."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.operators import metrics

HYP = ["the cat sat on the mat", "a b c d e f g", "hello world", "", "x y, z!", "the the the the", "p q r s t u v w"]
REF = ["the cat is on the mat", "a b c d e f g", "world hello", "some reference", "x y z", "the cat", "t u v w p q r s"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(zip(HYP, REF))], "id long, hyp string, ref string").repartition(2)


def grams(items, n):
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def bleu(hyp, ref):
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        m = sum(sum((grams(h.split(), n) & grams(r.split(), n)).values()) for h, r in zip(hyp, ref))
        t = sum(max(0, len(h.split()) - n + 1) for h in hyp)
        if not m:
            zeros += 1
        logs += math.log(m / t if m else 1 / (2**zeros * t)) / 4
    a, b = (sum(len(x.split()) for x in side) for side in (hyp, ref))
    return 100 * math.exp(logs) * (1 if a >= b else math.exp(1 - b / a))


def test_bleu(rows):
    assert metrics.corpus_bleu(rows, words(F.col("hyp")), words(F.col("ref"))).first().bleu == pytest.approx(bleu(HYP, REF))


def test_bleu_of_equal_and_other_texts(spark):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, hyp string, ref string")
    other = spark.createDataFrame([(1, "a b c d e", "v w x y z")], "id long, hyp string, ref string")
    score = lambda df: metrics.corpus_bleu(df, words(F.col("hyp")), words(F.col("ref"))).first().bleu
    assert score(same) == pytest.approx(100) and score(other) == 0 and score(same.limit(0)) == 0


def test_tokenizers(spark):
    row = spark.createDataFrame([("Hello, world! 3.5 (a-b)", "你好ab c")], "a string, b string").select(metrics.tokenize_13a(F.col("a")).alias("a"), metrics.tokenize_zh(F.col("b")).alias("b")).first()
    assert row.a == ["Hello", ",", "world", "!", "3.5", "(", "a-b", ")"] and row.b == ["你", "好", "ab", "c"]


def test_13a_decodes_entities_and_joins_lines(spark):
    texts = ["a &amp; b &quot;c&quot; &lt;d", "hyphen-\nated <skipped>line\nend", "1,000.5 a.b 3-4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, a string").select("i", metrics.tokenize_13a(F.col("a")).alias("a"))
    assert [r.a for r in rows.orderBy("i").collect()] == [["a", "&", "b", '"', "c", '"', "<", "d"], ["hyphenated", "line", "end"], ["1,000.5", "a", ".", "b", "3", "-", "4"]]


def test_zh_splits_punctuation_and_full_width_forms(spark):
    row = spark.createDataFrame([("他说：「你好」。ok（１２） 3.5",)], "a string").select(metrics.tokenize_zh(F.col("a")).alias("a")).first()
    assert row.a == ["他", "说", "：", "「", "你", "好", "」", "。", "ok", "（", "１", "２", "）", "3.5"]


def chrf_words(text):
    """Words; a mark at the end, or else at the beginning, is a word of its own."""
    return [x for w in text.split() for x in (re.fullmatch(r"(?s)(.+)([!-/:-@\[-`{-~])|([!-/:-@\[-`{-~])(.+)|(.+)", w).groups()) if x]


def chrf(hyp, ref):
    p, r = [], []
    for of, most in ((lambda t: list("".join(t.split())), 6), (chrf_words, 2)):
        for n in range(1, most + 1):
            m = a = b = 0
            for h, g in zip(hyp, ref):
                x, y = grams(of(h), n), grams(of(g), n)
                m, b = m + sum((x & y).values()), b + sum(y.values())
                a += sum(x.values()) if y else 0  # a hypothesis isn't counted where its reference has no such n-gram
            if a and b:
                p.append(m / a)
                r.append(m / b)
    p, r = sum(p) / len(p), sum(r) / len(r)
    return 100 * 5 * p * r / (4 * p + r)


def test_chrf(rows):
    assert metrics.corpus_chrf(rows).first().chrf == pytest.approx(chrf(HYP, REF))
    assert metrics.corpus_chrf(rows.limit(0)).first().chrf == 0


def test_chrf_on_lines(spark, sf_dir):
    from textloom.sources.adapters import hyp_ref

    lines = hyp_ref(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter(F.length("ref") < 300)
    found = [(r.hyp, r.ref) for r in lines.select("hyp", "ref").collect()]
    assert metrics.corpus_chrf(lines).first().chrf == pytest.approx(chrf(*zip(*found)))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_wer(rows):
    row = metrics.corpus_wer(rows, words(F.col("hyp")), words(F.col("ref"))).first()
    assert row.edits == sum(levenshtein(h.split(), r.split()) for h, r in zip(HYP, REF))
    assert row.wer == pytest.approx(100 * row.edits / sum(len(r.split()) for r in REF))


def test_edit_distance():
    assert all(metrics.edit_distance(h.split(), r.split()) == levenshtein(h.split(), r.split()) for h in HYP for r in REF)


def test_ter_moves_blocks(rows):
    assert metrics.shifted_edits("p q r s t u v w".split(), "t u v w p q r s".split()) == 1
    assert metrics.shifted_edits([], ["a"]) == 1 and metrics.shifted_edits(["a"], []) == 1
    row = metrics.corpus_ter(rows).first()
    assert row.edits == sum(metrics.shifted_edits(h.split(), r.split()) for h, r in zip(HYP, REF))


def test_one_word_of_ten(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i x", "a b c d e f g h i j")], "id long, hyp string, ref string")
    assert metrics.corpus_wer(rows, words(F.col("hyp")), words(F.col("ref"))).first().wer == 10


@pytest.mark.parametrize("mode, low, high", [("standard", 0.0, 0.02), ("centred", 0.3, 0.7)])
def test_bootstraps_agree(spark, mode, low, high):
    scores = spark.range(1, 201).select(F.col("id").alias("pos"), F.lit(0.0).alias("a"), (F.col("id") % 10 / 10 - 0.2).alias("b"))
    for f in (metrics.paired_bootstrap, metrics.poisson_bootstrap):
        row = f(scores, "pos", "a", "b", 200, mode).first()
        assert row.n == 200 and row.observed == pytest.approx(0.25) and low <= row.p <= high
    with pytest.raises(ValueError):
        metrics.paired_bootstrap(scores, "pos", "a", "b", 10, "other")


def test_wer_of_very_long_texts(spark):
    """50,000 words, most of them distinct: a word left out, one changed and one more."""
    ref = [f"w{i}" for i in range(50_000)]
    hyp = ref[:100] + ref[101:20_000] + ["other"] + ref[20_001:] + ["more"]
    rows = spark.createDataFrame([(" ".join(hyp), " ".join(ref)), ("a b", "a c"), ("x", None)], "hyp string, ref string")
    found = metrics.corpus_wer(rows, words(F.col("hyp")), words(F.col("ref"))).first()
    assert (found.edits, found.ref_words) == (4, 50_002)


def test_both_ways_to_count_edits_agree(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(" ".join(rng.choices("abcdefg", k=rng.randrange(0, 30))), " ".join(rng.choices("abcdefg", k=rng.randrange(0, 30)))) for _ in range(100)], "hyp string, ref string")
    few = metrics.corpus_wer(rows, words(F.col("hyp")), words(F.col("ref"))).first()
    monkeypatch.setattr(metrics, "FEW_WORDS", 0)
    assert metrics.corpus_wer(rows, words(F.col("hyp")), words(F.col("ref"))).first() == few


def test_evaluate_gives_what_is_asked_for(rows):
    found = metrics.evaluate(rows.withColumn("comet", F.col("id") / 10), ("bleu", "ter", "comet", "bertscore")).first()
    assert found.bleu is not None and found.ter is not None and found.comet == pytest.approx(0.3)
    assert found.chrf is None and found.wer is None and found.bertscore is None
    with pytest.raises(ValueError):
        metrics.evaluate(rows, ("rouge",))


ODD = ["a", "5", "b", " ", "  ", ".", ",", "..", "-", "'", "\t", "\n", "-\n", "\x1c", "\x85", " ", " ", "　", "&amp;", "&lt;", "&quot;", "<skipped>", "~", "/", "@", "(", "{", "[", "é", "中", "ß", "Σ"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choices(ODD, k=rng.randrange(14)))
    rows = [(text(), text()) for _ in range(4000)] + [(None, "a b"), ("a b", None), (None, None), ("", " ")]
    return spark.createDataFrame(rows, "hyp string, ref string").repartition(4)


def test_texts_are_split_in_tasks_as_by_columns(odd):
    """F11, F14, F16: columns cut texts into words by patterns in the JVM before."""
    import pyarrow as pa

    found = odd.select("ref", metrics.tokenize_13a(F.col("ref")).alias("a"), words(F.col("ref")).alias("w")).collect()
    texts = pa.array([r.ref for r in found])
    for split, column in ((metrics.split_13a, "a"), (metrics.split_words, "w")):
        all_words, n = split(texts)
        assert all_words.to_pylist() == [w for r in found for w in r[column] or []] and n.tolist() == [len(r[column] or []) for r in found]


def test_sums_of_texts_are_those_of_words(odd):
    h, r = F.col("hyp"), F.col("ref")
    assert metrics.corpus_bleu(odd, h, r, split=metrics.split_13a).first() == metrics.corpus_bleu(odd, metrics.tokenize_13a(h), metrics.tokenize_13a(r)).first()
    assert metrics.corpus_bleu(odd, h, r).first() == metrics.corpus_bleu(odd, words(h), words(r)).first()
    assert metrics.corpus_wer(odd, h, r).first() == metrics.corpus_wer(odd, words(h), words(r)).first()
    row = metrics.corpus_ter(odd).first()
    pairs = [((x.hyp or "").split(), (x.ref or "").split()) for x in odd.select(F.lower("hyp").alias("hyp"), F.lower("ref").alias("ref")).collect()]
    assert row.edits == sum(metrics.shifted_edits(a, b) for a, b in pairs)
    assert row.ref_words == odd.agg(F.sum(F.size(words(r))).alias("n")).first().n


def test_chrf_of_odd_texts(odd):
    pairs = [(x.hyp or "", x.ref or "") for x in odd.collect()]
    assert metrics.corpus_chrf(odd).first().chrf == pytest.approx(chrf(*zip(*pairs)))


def test_evaluate_reads_texts_without_patterns(odd):
    """F8: words were cut by patterns in the JVM, once for each metric."""
    wanted = metrics.evaluate(odd, ("bleu", "wer"), tokenize=lambda c: metrics.tokenize_13a(c)).first()
    assert metrics.evaluate(odd, ("bleu", "wer")).first() == wanted


def test_most_grams_are_paired_without_sorting(monkeypatch):
    """F13, F16: all n-grams of all orders were sorted before."""
    import numpy as np

    rng = random.Random(2)
    ref = [rng.randrange(5000) for _ in range(20_000)]
    hyp = [x for x in ref if rng.random() > 0.06]
    sizes, least = [], metrics._least
    monkeypatch.setattr(metrics, "_least", lambda a, b: sizes.append(len(a) + len(b)) or least(a, b))
    n = [np.array([len(x)], np.int64) for x in (hyp, ref)]
    sums = metrics._gram_sums(np.array(hyp), n[0], np.array(ref), n[1], 4)
    assert sums[:, 0].tolist() == [sum((grams(hyp, k) & grams(ref, k)).values()) for k in range(1, 5)]
    assert len(sizes) == 4 and sum(sizes) < len(hyp) + len(ref)
