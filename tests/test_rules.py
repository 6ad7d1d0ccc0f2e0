"""Boundary cases of functions and rules, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays, scores, text
from textloom.functions.registry import register
from textloom.operators import augment, cleaning, curriculum, filtering, lookup, sampling, splits
from textloom.operators.order import ranked, shuffle_key


def one(spark, column, **values):
    """A column over one row of values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


C = F.col


@pytest.mark.parametrize(
    "given, want",
    [("<p>Hi&nbsp;&lt;b&gt;</p>", "Hi <b>"), ("&amp;lt;", "&lt;"), ("ＡＢＣ　x", "ABC x"), ("a@b.com see http://x.y/z", "see"), ("a \x07 b", "a b"), ("", ""), ("  ", "")],
)
def test_clean_text(spark, given, want):
    assert one(spark, text.clean_text(C("t")), t=given) == want


def test_nulls_stay_null(spark):
    for f in (text.clean_text, text.collapse_space, text.strip_html, text.wmt_normalize):
        assert spark.sql("SELECT CAST(NULL AS STRING) t").select(f(C("t")).alias("x")).first().x is None


def test_wmt_normalize(spark):
    assert one(spark, text.wmt_normalize(C("t")), t="a\tb  c") == "ab c"
    assert one(spark, text.wmt_normalize(C("t"), spaced=False), t="你 好") == "你好"


@pytest.mark.parametrize("given, want", [("a b c a b c", 0.25), ("a a a a a", 2 / 3), ("好好好好", 0.5), ("a b", 0.0), ("", 0.0)])
def test_repeat_ratio(spark, given, want):
    assert one(spark, arrays.repeat_ratio(text.tokens(C("t"))), t=given) == pytest.approx(want)


def test_mostly_han_is_strict(spark):
    assert one(spark, text.mostly_han(C("t")), t="好好好abcdefg") is False
    assert one(spark, text.mostly_han(C("t")), t="好好好好abcdef") is True


@pytest.mark.parametrize("a, b, want", [(5, 11, "valid"), (4, 50, "zh_length"), (5, 9, "en_length"), (10, 10, "ratio"), (0, 10, "empty"), (8, 10, "valid"), (201, 400, "zh_length"), (50, 501, "en_length"), (50, 500, "valid")])
def test_cascade(spark, a, b, want):
    assert one(spark, cleaning.reject_reason(C("s"), C("t")), s="x" * a, t="y" * b) == want


def test_language_rule(spark):
    rules = cleaning.CleaningRules(check_language=True)
    assert one(spark, cleaning.reject_reason(C("s"), C("t"), rules), s="abcdef", t="y" * 20) == "zh_lang"
    assert one(spark, cleaning.reject_reason(C("s"), C("t"), rules, C("l")), s="好好好def", t="y" * 20, l="de") == "en_lang"


def test_first_of_equal_pairs_survives(spark):
    rows = spark.createDataFrame([(3, "aaaaa", "b" * 12, "x"), (1, "aaaaa ", " " + "b" * 12, "y"), (2, "ccccc", "d" * 12, "z")], "pair_id long, src string, tgt string, source string")
    assert sorted((r.pair_id, r.source) for r in cleaning.clean(rows).collect()) == [(1, "y"), (2, "z")]
    assert cleaning.clean(rows.limit(0)).count() == 0 and cleaning.cleaning_stats(rows.limit(0)).first().retention_rate == 0


@pytest.mark.parametrize("r, kept", [(25, 1), (50, 1), (24, 0), (51, 0)])
def test_ratio_filter_is_inclusive(spark, r, kept):
    rows = spark.createDataFrame([("x" * r, "y" * 100), ("x", "")], "src string, tgt string")
    assert filtering.ratio_filter(rows).count() == kept


def test_fallback_similarity(spark):
    assert one(spark, scores.fallback_similarity(C("s"), C("t")), s="12345678", t=" ".join("a" * 10)) == 0.8
    assert one(spark, scores.fallback_similarity(C("s"), C("t")), s="", t="") == 0


@pytest.mark.parametrize("chars, words, sim, want", [(49, 10, 0.85, "easy"), (49, 10, 0.84, "medium"), (150, 10, 0.99, "hard")])
def test_filter_difficulty(spark, chars, words, sim, want):
    assert one(spark, scores.filter_difficulty(C("s"), C("t"), C("v")), s="x" * chars, t=" ".join("a" * words), v=sim) == want


@pytest.mark.parametrize("chars, words, want", [(10, 8, "easy"), (10, 2, "hard"), (200, 100, "hard"), (30, 30, "medium"), (3, 0, "easy")])
def test_sampler_difficulty(spark, chars, words, want):
    assert one(spark, scores.sampler_difficulty(C("s"), C("t")), s="x" * chars, t=" ".join("a" * words)) == want


@pytest.mark.parametrize("value, want", [(0.15, 2), (0.35, 6), (0.7, 13), (0.75, 15), (0.8, 16), (0.85, 17), (0.95, 18), (1.0, 20)])
def test_similarity_bucket(spark, value, want):
    assert one(spark, sampling.similarity_bucket(C("v")), v=value) == want


def test_difficulty_score(spark):
    assert one(spark, scores.difficulty_score(C("n"), C("s"), F.lit(0.0)), n=50, s=0.8) == pytest.approx(0.28)


@pytest.mark.parametrize("n, want", [(1000, (900, 50, 50)), (11, (9, 0, 2)), (10, (9, 0, 1)), (0, (0, 0, 0))])
def test_split_sizes(spark, n, want):
    found = dict(splits.train_val_test(spark.range(n), "id").groupBy("split").count().collect())
    assert tuple(found.get(k, 0) for k in ("train", "val", "test")) == want


def test_split_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.train_val_test(spark.range(3), "id", 0.8, 0.05, 0.05)


@pytest.mark.parametrize("n, want", [(32, 0), (33, 1), (512, 4), (513, 5)])
def test_length_bucket(spark, n, want):
    assert one(spark, splits.length_bucket(C("n")), n=n) == want


def test_batches(spark):
    rows = spark.range(13).withColumn("b", (F.col("id") >= 10).cast("int"))
    sizes = lambda drop: sorted(r["count"] for r in splits.bucket_batches(rows, "b", "id", 4, drop).groupBy("b", "batch_id").count().collect())
    assert sizes(False) == [2, 3, 4, 4] and sizes(True) == [4, 4]


def test_stages_of_epochs(spark):
    stages = lambda n: [r.s for r in spark.range(n).select("id", curriculum.stage_of_epoch(C("id"), n).alias("s")).orderBy("id").collect()]
    assert stages(10) == ["easy"] * 3 + ["medium"] * 4 + ["hard"] * 3
    assert stages(5) == ["easy"] * 2 + ["medium"] * 2 + ["hard"]


def test_active_rows_fall_back(spark):
    rows = spark.createDataFrame([(1, "medium"), (2, "hard")], "id long, stage string")
    assert [r.id for r in curriculum.active_rows(rows, 0, 10, "id").collect()] == [1]
    assert curriculum.active_rows(rows, 9, 10, "id").count() == 2


def test_softmax_weights(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 3.0)], "d string, v double")
    found = {r.d: r.weight for r in curriculum.softmax_weights(rows, "v").collect()}
    assert [round(found[k], 4) for k in "abc"] == [0.09, 0.2447, 0.6652]


def test_mixing_ratio(spark):
    real, made = (spark.range(a, b).select(F.col("id").alias("pair_id")) for a, b in ((0, 5), (10, 20)))
    mixed = augment.mix_synthetic(real, made, 0.5)
    assert dict(mixed.groupBy("is_synthetic").count().collect()) == {False: 5, True: 2}


@pytest.mark.parametrize("src, tgt, conf, kept", [(9, 3, 0.7, 1), (10, 3, 0.9, 0), (1, 3, 0.9, 1), (3, 3, 0.69, 0)])
def test_synthetic_filter(spark, src, tgt, conf, kept):
    rows = spark.createDataFrame([("x" * src, "y" * tgt, conf)], "src string, tgt string, confidence double")
    assert filtering.synthetic_filter(rows).count() == kept


def test_noam_rate(spark):
    assert one(spark, scores.noam_rate(C("s")), s=1) == pytest.approx(1.746928e-07, rel=1e-6)
    assert one(spark, scores.noam_rate(C("s")), s=4000) == pytest.approx(6.987712e-04, rel=1e-6)


def test_int4(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "x double")
    assert [r.q for r in rows.select(arrays.int4(C("x"), F.lit(-1.0), F.lit(2.0)).alias("q")).collect()] == [-8, -3, 7]


def test_prefix_lookup_takes_the_longest(spark):
    cache = spark.createDataFrame([("你好", "a"), ("你", "b"), ("x", "c")], "prefix string, value string")
    found = lookup.longest_prefix(spark.createDataFrame([(1, "你好世界"), (2, "y"), (3, None)], "id long, text string"), cache, "id")
    assert [tuple(r) for r in found.collect()] == [(1, "你好", "a")]


def test_term_matches_by_target_only_and_in_blocks(spark, monkeypatch):
    terms = spark.createDataFrame([(i, f"term{i}q", f"ziel{i}q", "tech") for i in range(30)], "term_id long, source string, target string, category string")
    texts = spark.createDataFrame([(1, "has ziel7q"), (2, "term3q and term29q"), (3, "none")], "id long, text string")
    want = [(1, 7), (2, 3), (2, 29)]
    assert sorted((r.id, r.term_id) for r in lookup.match_terms(texts, terms).collect()) == want
    monkeypatch.setattr(lookup, "MOST_TERMS", 7)
    assert sorted((r.id, r.term_id) for r in lookup.match_terms(texts, terms).collect()) == want


def test_ranks_are_those_of_one_window(spark):
    rows = spark.range(2000).withColumn("g", F.col("id") % 3)
    found = {r.id: r.rank for r in ranked(rows, shuffle_key(C("id")), "id", ["g"]).collect()}
    import hashlib

    for g in range(3):
        order = sorted((i for i in range(2000) if i % 3 == g), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [found[i] for i in order] == list(range(1, len(order) + 1))


def test_padding_and_masks(spark):
    ids = F.array(F.lit(5), F.lit(6), F.lit(7))
    assert one(spark, arrays.padded(ids, 5)) == [5, 6, 7, 0, 0] and one(spark, arrays.padded(ids, 2)) == [5, 6]
    assert one(spark, arrays.attention_mask(ids, 5)) == [1, 1, 1, 0, 0] and one(spark, arrays.labels(ids, 4)) == [5, 6, 7, -100]


def test_label_smoothing(spark):
    logs = F.array(*[F.lit(math.log(p)) for p in (0.1, 0.2, 0.3, 0.4)])
    want = -(0.05 * math.log(0.2) + 0.9 * math.log(0.3) + 0.05 * math.log(0.4))
    assert one(spark, arrays.smoothed_cross_entropy(logs, F.lit(2))) == pytest.approx(want)


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT collapse_space(' a  b ') a, strip_tags('<b>x</b>') b, word_count(' p  q ') c, length_ratio('ab', '') d, length_bucket(33) e, cosine(array(1D, 0D), array(1D, 0D)) f, pair_hash('a ', ' b') g").first()
    assert tuple(row)[:6] == ("a b", "x", 2, 0.0, 1, 1.0)
    assert row.g == one(spark, text.pair_hash(C("a"), C("b")), a="a", b="b")


def test_swapping_keeps_words(spark):
    rows = spark.range(200).select("id", F.array(*[F.lit(w) for w in "abcde"]).alias("w"))
    found = [r.x for r in rows.select(augment.swap_words(C("w"), C("id"), 0.5).alias("x")).collect()]
    assert all(sorted(x) == list("abcde") for x in found) and 50 < sum(x != list("abcde") for x in found) < 150
    kept = [r.x for r in rows.select(augment.drop_words(C("w"), C("id"), 0.9).alias("x")).collect()]
    assert all(kept) and sum(map(len, kept)) < 400


def test_stratified_takes_exactly_the_target(spark):
    rows = spark.range(50).select(F.col("id").alias("pair_id"), (F.col("id") / 50).alias("similarity_score"), (F.col("id") % 3).cast("string").alias("difficulty"), F.lit("short").alias("length_group"))
    assert sampling.stratified(rows, 10).count() == 10 and sampling.stratified(rows, 2).count() == 2
    assert sampling.stratified(rows, 100).count() == 50 and sampling.stratified(rows.limit(0), 10).count() == 0
    per = dict(sampling.stratified(rows, 10).groupBy("difficulty").count().collect())
    assert sorted(per.values()) == [3, 3, 4]


def test_with_replacement(spark):
    out = [r.id for r in curriculum.with_replacement(spark.range(10), 100, "id").collect()]
    assert len(out) == 100 and set(out) <= set(range(10)) and len(set(out)) > 5
    assert curriculum.with_replacement(spark.range(0), 5, "id").count() == 0


def test_formats(spark):
    assert [one(spark, text.format_time(C("s")), s=s) for s in (5, 90, 7200)] == ["5.0s", "1.5m", "2.0h"]
    assert one(spark, text.clock(C("s")), s=3725) == "01:02:05"
    assert one(spark, text.preview(C("t")), t="x" * 60) == "x" * 50 + "..."
