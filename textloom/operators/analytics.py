"""Report analytics: summaries, histograms, rankings, frontiers and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import scan
from textloom.operators.quantiles import quantiles

def score_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, median (interpolated), population deviation, minimum and maximum."""
    v = F.col(value)
    rest = df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    median = quantiles(df, value, [0.5], [], ["median"])
    return rest.crossJoin(F.broadcast(median)).select("mean", "median", "std", "low", "high")  # a row each


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n): bins of equal width over the values' range, the last one closed. Values that are all equal are in bin 0; null and empty bins aren't listed."""
    ends = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    at = F.floor((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * bins)
    bin_ = F.when(F.col("__high") > F.col("__low"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("int")
    rows = df.select(value).filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """(bin, n, share): a histogram whose shares sum to 1."""
    h = histogram(df, value, bins)
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("__all")))).select("bin", "n", (F.col("n") / F.col("__all")).alias("share"))


def box_stats(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Per group: q1, median, q3, and the whiskers, the furthest values within 1.5 interquartile ranges of the box."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], list(groups), ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(*groups, value)
    rows = rows.join(q, list(groups)) if groups else rows.crossJoin(F.broadcast(q))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return rows.groupBy(*groups, "q1", "median", "q3").agg(F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"))


def threshold_counts(df: DataFrame, value: str, least: float) -> DataFrame:
    return df.agg(F.count_if(F.col(value) >= least).alias("kept"), F.count_if(F.col(value) < least).alias("filtered"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of a column's values; only the counts meet."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def size_ratios(models: DataFrame, size: str, *groups: str) -> DataFrame:
    """models with compression (largest size over own) and width (own size in per cent of the largest), within groups."""
    most = F.max(size).over(Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0)))
    return models.withColumn("compression", F.try_divide(most, F.col(size))).withColumn("width", F.try_divide(F.col(size) * 100.0, most))


def domain_pivot(scores: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each model and a column for each domain, 0 where there is no score. columns: known domains, which saves a pass."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0.0)


def efficiency(runs: DataFrame, quality: str, latency: str, size: str) -> DataFrame:
    """runs with score: 60 parts quality against the best, 20 parts each for latency and size against the least; parts of values up to 0 are 0."""
    best = runs.agg(F.max(quality).alias("__q"), F.min(F.when(F.col(latency) > 0, F.col(latency))).alias("__l"), F.min(F.when(F.col(size) > 0, F.col(size))).alias("__s"))
    part = lambda a, b, ok: F.when(ok, a / b).otherwise(0.0)
    score = part(F.col(quality), F.col("__q"), F.col("__q") > 0) * 60 + part(F.col("__l"), F.col(latency), F.col(latency) > 0) * 20 + part(F.col("__s"), F.col(size), F.col(size) > 0) * 20
    return runs.crossJoin(F.broadcast(best)).withColumn("score", score).drop("__q", "__l", "__s")


def radar(runs: DataFrame, group: str, quality: str, latency: str, size: str) -> DataFrame:
    """runs with quality, speed (1000 / latency) and compactness (1000 / size) in per cent of the best of their group."""
    w = Window.partitionBy(group)
    speed, compact = F.try_divide(F.lit(1000.0), F.col(latency)), F.try_divide(F.lit(1000.0), F.col(size))
    share = lambda c: F.coalesce(F.try_divide(c * 100, F.max(c).over(w)), F.lit(0.0))
    return runs.withColumns({"quality_share": share(F.col(quality)), "speed_share": share(speed), "compact_share": share(compact)})


def pareto(runs: DataFrame, group: str, cost: str, quality: str, tie: str) -> DataFrame:
    """The runs that are better than all cheaper ones of their group."""
    rows = scan.prefixes(runs, [group], [cost, tie], __best=("max", quality))
    return rows.filter(F.col(quality) > F.coalesce("__best", F.lit(-1.0))).drop("__best")


def dimension_importance(vectors: DataFrame, vector: str, kind: str = "l1") -> DataFrame:
    """(pos, importance) of each dimension over all vectors: l1, l2 or max of absolute values."""
    x = F.col("x").cast("double")
    of = {"l1": F.sum(F.abs(x)), "l2": F.sqrt(F.sum(x * x)), "max": F.max(F.abs(x))}[kind]
    return vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(of.alias("importance"))


def top_mask(importance: DataFrame, prune: float) -> DataFrame:
    """(pos, importance, kept): the most important floor(n * (1 - prune)) dimensions stay, one at least. A row for each dimension."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.desc("importance"), "pos"))
    return importance.withColumn("kept", rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(every) * F.lit(1 - prune))))


def step_ratio(total: float, steps: int) -> float:
    """The share to prune in each of some steps, to reach a total share."""
    return 1 - (1 - total) ** (1 / steps)


def checkpoint_average(checkpoints: DataFrame, step: str, vector: str, last: int) -> DataFrame:
    """(pos, value): the mean of the last checkpoints' vectors, element by element."""
    newest = checkpoints.orderBy(F.desc(step)).limit(last)
    return newest.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def weighted_ensemble(rows: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """(group, pos, value): mean of vectors by weight."""
    x = rows.select(group, weight, F.posexplode(vector).alias("pos", "x"))
    return x.groupBy(group, "pos").agg((F.sum(F.col(weight) * F.col("x").cast("double")) / F.sum(weight)).alias("value"))


def parameter_counts(parameters: DataFrame, count: str, trainable: str, bytes_each: int = 4) -> DataFrame:
    """One row: total, trainable and frozen parameters, and MB."""
    n = F.col(count)
    return parameters.agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col(trainable), n)), F.lit(0)).alias("trainable"), F.coalesce(F.sum(F.when(~F.col(trainable), n)), F.lit(0)).alias("frozen"), (F.sum(n) * bytes_each / 2**20).alias("mb"))


def service_stats(requests: DataFrame, cached: str, latency: str) -> DataFrame:
    """One row: requests, hits, hit rate, and the mean latency of what wasn't cached."""
    c = F.col(cached)
    return requests.agg(F.count("*").alias("requests"), F.count_if(c).alias("hits"), F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)).alias("hit_rate"), F.avg(F.when(~c, F.col(latency))).alias("avg_latency"))


def remaining_seconds(epochs: DataFrame, seconds: str, total: int) -> DataFrame:
    """One row: mean time of an epoch, and what the epochs to come take by it."""
    return epochs.agg(F.avg(seconds).alias("mean"), (F.avg(seconds) * F.greatest(F.lit(total) - F.count("*"), F.lit(0))).alias("remaining"))


def memory_tier(gb: Column) -> Column:
    """Batch size and concurrency for so much memory, a tenth of it kept free."""
    free = gb * 0.9
    tier = lambda batch, n: F.struct(F.lit(batch).alias("batch"), F.lit(n).alias("concurrency"))
    return F.when(free >= 12, tier(64, 16)).when(free >= 8, tier(32, 8)).when(free >= 6, tier(16, 4)).otherwise(tier(8, 2))


def perplexity(losses: DataFrame, loss: str, *groups: str) -> DataFrame:
    return losses.groupBy(*groups).agg(F.exp(F.avg(loss)).alias("perplexity"))


def model_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, mb) of the files below a path; only their metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), (F.sum("length") / 2**20).alias("mb"))


def last_status(log: DataFrame, step: str, status: str, at: str) -> DataFrame:
    """(step, status): the newest status of each step."""
    return log.groupBy(step).agg(F.max_by(status, at).alias(status))


# --- Series


def smoothed(series: DataFrame, run: str, step: str, value: str, keep: float = 0.9) -> DataFrame:
    """(run, step, smoothed): s = keep * s before + (1 - keep) * value, from the first value on, exactly for any keep; a long series is many tasks' work."""
    return scan.exponential(series, run, step, value, keep)


def running_mean(series: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """series with the mean of all values up to each step; null where there is none."""
    sums = scan.prefixes(series, [run], [step], inclusive=True, __sum=("sum", value), __n=("count", value))
    return sums.withColumn("running_mean", F.try_divide("__sum", "__n")).drop("__sum", "__n")


def best_so_far(series: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """The rows whose value is less than all before them in their run: where a checkpoint is kept."""
    rows = scan.prefixes(series, [run], [step], __best=("min", value))
    return rows.filter(F.col("__best").isNull() | (F.col(value) < F.col("__best"))).drop("__best")


def extremes(series: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Per run: the least and greatest value, and at which step (the first of equal ones)."""
    least, most = F.min(F.struct(value, step)), F.max(F.struct(F.col(value), -F.col(step)))
    return series.groupBy(run).agg(least.alias("a"), most.alias("b")).select(run, F.col(f"a.{value}").alias("low"), F.col(f"a.{step}").alias("low_step"), F.col(f"b.{value}").alias("high"), (-F.col("b.col2")).alias("high_step"))


def last_n(series: DataFrame, run: str, step: str, n: int = 100) -> DataFrame:
    w = Window.partitionBy(run).orderBy(F.desc(step))
    return series.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def accumulation_groups(series: DataFrame, run: str, step: str, value: str, k: int) -> DataFrame:
    """(run, update, mean): k steps make an update; a rest that doesn't fill one is left out. Steps count from 1."""
    return series.groupBy(run, F.floor((F.col(step) - 1) / k).alias("update")).agg(F.avg(value).alias("mean"), F.count("*").alias("__n")).filter(F.col("__n") == k).drop("__n")


def spaced_axis(series: DataFrame, run: str, step: str, last: float) -> DataFrame:
    """series with x: the run's points evenly from 0 to last. Steps count from 1."""
    n = F.max(step).over(Window.partitionBy(run))
    return series.withColumn("x", F.when(n > 1, (F.col(step) - 1) * F.lit(last) / (n - 1)).otherwise(0.0))


def peak_concurrency(requests: DataFrame, start: str, end: str, *groups: str) -> DataFrame:
    """(groups, peak): how many requests were open at once; one that ends when another starts doesn't count with it.

    Requests that start or end at one time are one row before anything is ordered, ends before starts.
    """
    moment = lambda c, d: F.struct(F.col(c).alias("at"), F.lit(d).alias("d"))
    events = requests.select(*groups, F.explode(F.array(moment(start, 1), moment(end, -1))).alias("e"))
    changes = events.groupBy(*groups, F.col("e.at").alias("__at"), F.col("e.d").alias("__d")).agg(F.sum("e.d").alias("__by"))
    opened = scan.prefixes(changes, list(groups), ["__at", "__d"], inclusive=True, __open=("sum", "__by"))
    return opened.groupBy(*groups).agg(F.max("__open").alias("peak"))
