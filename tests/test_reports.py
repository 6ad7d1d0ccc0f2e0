"""Analytics, serving and token operators on cases worked out by hand."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics, serving, tokens


def test_histogram_ends(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,)], "x double")
    found = {r.bin: r.n for r in analytics.histogram(rows, "x").collect()}
    assert found[49] == 3 and found[0] == 2 and sum(found.values()) == 101
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [tuple(r) for r in analytics.histogram(same, "x").collect()] == [(0, 2)]
    assert analytics.histogram(same.limit(0), "x").count() == 0
    assert sum(r.share for r in analytics.density(rows, "x").collect()) == pytest.approx(1)


def test_box_without_groups(spark):
    rows = spark.createDataFrame([(float(x),) for x in [*range(1, 10), 100]], "x double")
    r = analytics.box_stats(rows, "x").first()
    assert (r.q1, r.median, r.q3, r.low_whisker, r.high_whisker) == (3.25, 5.5, 7.75, 1.0, 9.0)


def test_pareto(spark):
    rows = spark.createDataFrame([("a", 1.0, 20.0, 1), ("a", 2.0, 19.0, 2), ("a", 3.0, 25.0, 3), ("a", 4.0, 25.0, 4)], "g string, cost double, q double, id long")
    assert sorted(r.id for r in analytics.pareto(rows, "g", "cost", "q", "id").collect()) == [1, 3]


def test_smoothing_over_blocks(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.random() for _ in range(1500)]
    rows = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(values)] + [("one", 1, 5.0)], "run string, step long, v double").repartition(3)
    want, s = [], values[0]
    for v in values:
        s = 0.9 * s + 0.1 * v
        want.append(s)
    found = {(r.run, r.step): r.smoothed for r in analytics.smoothed(rows, "run", "step", "v").collect()}
    assert [found["r", i + 1] for i in range(1500)] == pytest.approx(want) and found["one", 1] == pytest.approx(5.0)
    assert [round(x, 6) for x in (1, 1.1, 1.29)] == [round(r.smoothed, 6) for r in analytics.smoothed(spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3)], "run string, step long, v double"), "run", "step", "v").orderBy("step").collect()]


def test_importance_and_masks(spark):
    rows = spark.createDataFrame([([1.0, -3.0, 2.0] + [0.0] * 7,), ([1.0, 1.0, 0.5] + [0.1] * 7,)], "v array<double>")
    l1 = {r.pos: r.importance for r in analytics.dimension_importance(rows, "v").collect()}
    assert (l1[0], l1[1], l1[2]) == (2.0, 4.0, 2.5)
    assert {r.pos: r.importance for r in analytics.dimension_importance(rows, "v", "max").collect()}[1] == 3.0
    assert {r.pos: r.importance for r in analytics.dimension_importance(rows, "v", "l2").collect()}[1] == pytest.approx(10**0.5)
    kept = [r.pos for r in analytics.top_mask(analytics.dimension_importance(rows, "v"), 0.7).filter("kept").collect()]
    assert sorted(kept) == [0, 1, 2]
    assert analytics.step_ratio(0.75, 2) == pytest.approx(0.5)


def test_small_reports(spark):
    p = spark.createDataFrame([(100, True), (28, False)], "n long, t boolean")
    assert tuple(analytics.parameter_counts(p, "n", "t").first())[:3] == (128, 100, 28)
    assert tuple(analytics.remaining_seconds(spark.createDataFrame([(10.0,), (20.0,)], "s double"), "s", 5).first()) == (15.0, 45.0)
    tiers = spark.createDataFrame([(24.0,), (10.0,), (7.0,), (4.0,)], "gb double").select(analytics.memory_tier(F.col("gb")).alias("t"))
    assert [tuple(r.t) for r in tiers.collect()] == [(64, 16), (32, 8), (16, 4), (8, 2)]
    log = spark.createDataFrame([("a", "run", 1), ("a", "done", 2), ("b", "failed", 1)], "step string, status string, at long")
    assert sorted(map(tuple, analytics.last_status(log, "step", "status", "at").collect())) == [("a", "done"), ("b", "failed")]
    open_ = spark.createDataFrame([("g", 0, 5), ("g", 1, 3), ("g", 3, 4)], "g string, a long, b long")
    assert [tuple(r) for r in analytics.peak_concurrency(open_, "a", "b", "g").collect()] == [("g", 2)]


def test_lru_evicts_the_oldest(spark):
    c = serving.LruCache(2)
    assert [c.ask(k) for k in "abacb"] == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1)]
    big = serving.LruCache(10, 100)
    assert [big.ask("a", 60), big.ask("b", 60), big.ask("huge", 500), big.ask("huge", 500)] == [(False, 0), (False, 1), (False, 1), (True, 0)]


def test_lru_simulation_streams(spark):
    rng = random.Random(1)
    log = [(i, rng.choice("xy"), f"k{int(rng.expovariate(0.1))}") for i in range(5000)]
    want = {}
    for cache in "xy":
        kept, hits, gone = OrderedDict(), 0, 0
        for _, c, k in log:
            if c == cache:
                if k in kept:
                    hits += 1
                    kept.move_to_end(k)
                else:
                    if len(kept) >= 8:
                        kept.popitem(last=False)
                        gone += 1
                    kept[k] = 1
        n = sum(c == cache for _, c, _ in log)
        want[cache] = (n, hits, gone, n - hits)
    df = spark.createDataFrame(log, "id long, c string, k string").repartition(5)
    assert {r.cache: (r.requests, r.hits, r.evictions, r.misses) for r in serving.lru_simulation(df, "c", "k", ["id"], 8).collect()} == want


def test_messages(spark):
    m = spark.createDataFrame([(1, "hi"), (2, "  "), (3, None)], "id long, text string")
    assert {r.id: r.error for r in serving.responses(m).collect()} == {1: None, 2: "empty text", 3: "empty text"}
    t = spark.createDataFrame([("s", 2, "b", False), ("s", 1, "a", False), ("s", 3, "c", True), ("s", 4, "late", False)], "s string, i long, t string, done boolean")
    assert [tuple(r) for r in serving.assembled(t, "s", "i", "t", "done").collect()] == [("s", "abc")]


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "d")], "id long, text string")
    split = F.split("text", " ")
    assert tuple(tokens.token_report(split, rows).first()) == (2, 4, 2.0, 1, 3)
    assert tuple(tokens.token_report(split, rows.limit(0)).first()) == (0, 0, 0.0, 0, 0)
    assert [r.tokens for r in tokens.token_samples(rows, split, "id", 5, 2).collect()] == [["a", "b"], ["d"]]
    assert [r.x for r in rows.select(tokens.compression_ratio(F.col("text"), split).alias("x")).collect()] == [5 / 3, 1.0]
    load = lambda: lambda texts: [[ord(c) for c in t] for t in texts]
    ids = tokens.encode(rows, "text", load, "id")
    assert {r.id: r.ids for r in ids.collect()}[2] == [100]
    back = tokens.decode(ids, lambda: lambda lists: ["".join(map(chr, x)) for x in lists], "id")
    assert sorted(map(tuple, back.collect())) == [(1, "a b c"), (2, "d")]
    pairs = spark.createDataFrame([("a  b c", "d e f"), ("a", "long enough")], "src string, tgt string")
    assert [tuple(r) for r in tokens.preprocess_pairs(pairs).collect()] == [("a b c", "d e f")]
