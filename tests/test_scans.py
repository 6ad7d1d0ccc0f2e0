"""Prefixes of long series, reuse distances, quantiles and the bootstrap against plain versions."""

import math
import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import analytics, metrics, reuse, scan, serving
from textloom.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def series(spark):
    """One series of 10,000 rows and some short ones, in no order, with nulls."""
    rng = random.Random(1)
    rows = [("long", i, rng.uniform(-5, 5)) for i in range(10_000)] + [(f"s{i % 50}", i, rng.gauss(3, 1)) for i in range(400)] + [("one", 1, 7.0), (None, 3, 2.0), (None, 1, 4.0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "run string, step long, v double").repartition(7)


def plain_smoothed(rows, keep):
    out, state = {}, {}
    for run, step, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[run] = state.get(run, v) * keep + v * (1 - keep)
        out[run, step] = state[run]
    return out


@pytest.mark.parametrize("keep", [0.0, 0.9, 0.99, 0.999, 1.0])
def test_smoothing_is_exact_for_any_keep(series, keep):
    rows, df = series
    got = {(r.run, r.step): r.smoothed for r in analytics.smoothed(df, "run", "step", "v", keep).collect()}
    want = plain_smoothed(rows, keep)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_a_keep_has_bounds(series):
    with pytest.raises(ValueError):
        scan.exponential(series[1], "run", "step", "v", 1.5)


@pytest.mark.parametrize("by", [["run"], []])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefixes_are_windows(series, by, inclusive):
    df = series[1].withColumn("v", F.when(F.col("step") % 7 > 0, F.round("v", 2)))
    order = ["step", "run"]
    got = scan.prefixes(df, by, order, inclusive, total=("sum", "v"), n=("count", "v"), low=("min", "v"), high=("max", "v"))
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("low"), F.max("v").over(w).alias("high"))
    key = lambda r: (str(r.run), r.step)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert (a.run, a.step, a.n, a.low, a.high) == (b.run, b.step, b.n, b.low, b.high) and a.total == pytest.approx(b.total, abs=1e-6)


def test_a_long_series_is_in_many_tasks(series):
    blocks = scan.in_blocks(series[1].filter("run = 'long'"), ["run"], ["step"])
    assert blocks.select("__block").distinct().count() > 1


def test_series_of_nothing(spark):
    df = spark.createDataFrame([], "run string, step long, v double")
    assert analytics.smoothed(df, "run", "step", "v").collect() == analytics.running_mean(df, "run", "step", "v").collect() == analytics.best_so_far(df, "run", "step", "v").collect() == []


def test_pareto_of_one_group(series):
    rows, df = series
    best, want = -1.0, []
    for _, step, v in sorted((r for r in rows if r[0] == "long"), key=lambda r: r[1]):
        if v > best:
            want.append(step)
            best = v
    assert sorted(r.step for r in analytics.pareto(df.filter("run = 'long'"), "run", "step", "v", "v").collect()) == want


def log(rng, n, keys):
    """Requests, a third of which are for one key."""
    return [(i, "hot" if rng.random() < 1 / 3 else f"k{int(rng.paretovariate(0.7)) % keys}") for i in range(n)]


@pytest.mark.parametrize("width", [10, 77, 100_000])
def test_reuse_distances(spark, monkeypatch, width):
    monkeypatch.setattr(reuse, "RANGE", width)
    rows = log(random.Random(width), 600, 90)
    got = {r.id: (r.before, r.distance) for r in reuse.reuse_distances(spark.createDataFrame(rows, "id long, k string").repartition(5), "k", ["id"]).collect()}
    last = {}
    for i, k in rows:
        want = (last[k] + 1, len({x for _, x in rows[last[k] + 1 : i]})) if k in last else (None, None)
        assert got[i] == want
        last[k] = i


def test_the_curve_is_what_caches_do(spark):
    rows = log(random.Random(3), 800, 60)
    curve = {r.entries: (r.requests, r.hits, r.misses, r.evictions) for r in reuse.lru_curve(reuse.reuse_distances(spark.createDataFrame(rows, "id long, k string"), "k", ["id"]), [1, 2, 5, 20, 1000]).collect()}
    for entries, found in curve.items():
        cache = serving.LruCache(entries)
        asked = [cache.ask(k) for _, k in rows]
        hits, gone = sum(a for a, _ in asked), sum(b for _, b in asked)
        assert found == (800, hits, 800 - hits, gone)
    none = reuse.lru_curve(reuse.reuse_distances(spark.createDataFrame([], "id long, k string"), "k", ["id"]), [3])
    assert [tuple(r) for r in none.collect()] == [(3, 0, 0, 0, 0)]


def test_earlier_and_smaller():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 300):
        x = rng.integers(0, max(1, n // 2), n)
        assert reuse.earlier_and_smaller(x).tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("bins", [2, 4096])
def test_quantiles_are_percentiles(spark, monkeypatch, bins):
    import textloom.operators.quantiles as module

    monkeypatch.setattr(module, "BINS", bins)
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1), 0.25, rng.uniform(-1e9, 1e-9)])) for _ in range(700)] + [("c", None), ("d", 3.0), (None, 1.0), (None, 2.0), ("e", 5e-324), ("e", 0.0), ("e", 1e-323)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: tuple(r)[1:] for r in quantiles(df, "v", probabilities, ["g"], [f"q{i}" for i in range(6)]).collect()}
    want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q")).filter("q IS NOT NULL").collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=0)
    assert [tuple(r) for r in quantiles(df.filter("g = 'c'"), "v", [0.5], [], ["m"]).collect()] == [(None,)]


def test_draws_of_all_blocks_are_n():
    """Each replicate draws n rows; a block gets the share of its rows, with the deviation of a binomial number."""
    draws = np.stack([metrics._draws_of(b, 95, 4000, 7, 10) for b in range(10)])
    assert (draws.sum(0) == 95).all()
    assert np.allclose(draws.mean(1), [10] * 9 + [5], atol=0.3)
    assert abs(draws[3].std() - math.sqrt(95 * (10 / 95) * (85 / 95))) < 0.15
    assert abs(np.corrcoef(draws[2], draws[7])[0, 1] + 10 / 85) < 0.05


def test_split_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BOOTSTRAP_BLOCK", 16)
    rng = random.Random(5)
    rows = [(i + 1, 0.0, rng.gauss(0.05, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "pos long, a double, b double").repartition(3)
    got = metrics.split_bootstrap(df, "pos", "a", "b", 2000).first()
    values = [r[2] for r in rows]
    plain = mean(mean(rng.choices(values, k=150)) <= 0 for _ in range(2000))
    assert (got.n, got.observed) == (150, pytest.approx(mean(values))) and abs(got.p - plain) < 0.05
    again = metrics.split_bootstrap(df.repartition(5), "pos", "a", "b", 2000).first()
    assert (again.n, again.p) == (got.n, got.p)
    assert abs(metrics.split_bootstrap(df, "pos", "a", "b", 500, mode="centred").first().p - 0.5) < 0.1
