"""Splits, length buckets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import word_count
from textloom.operators.order import ranked, shuffle_key

LENGTH_BOUNDS = (32, 64, 128, 256, 512)


def train_val_test(df: DataFrame, key: str, train: float = 0.9, val: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """df with split. Sizes are exact: floor(n * train), floor(n * val), and the rest for test."""
    if abs(train + val + test - 1) > 0.001:
        raise ValueError("ratios must sum to 1")
    n = df.agg(F.count("*").alias("__all"))
    rows = ranked(df, shuffle_key(F.col(key), seed), key, name="__n").crossJoin(F.broadcast(n))
    a = F.floor(F.col("__all") * F.lit(train))
    b = a + F.floor(F.col("__all") * F.lit(val))
    return rows.withColumn("split", F.when(F.col("__n") <= a, "train").when(F.col("__n") <= b, "val").otherwise("test")).drop("__n", "__all")


def length_bucket(length: Column, bounds: tuple[int, ...] = LENGTH_BOUNDS) -> Column:
    """Index of the first bound that isn't below the length, or how many bounds there are."""
    out = F.when(length <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(length <= b, i)
    return out.otherwise(len(bounds))


def bucket_batches(df: DataFrame, bucket: str, key: str, size: int = 32, drop_last: bool = False, seed: int = 42) -> DataFrame:
    """df with batch_id: rows of a bucket in random order, size at a time; drop_last leaves out what doesn't fill a batch."""
    rows = ranked(df, shuffle_key(F.col(key), seed), key, [bucket], "__n").withColumn("batch_id", F.floor((F.col("__n") - 1) / size).cast("long"))
    if drop_last:
        sizes = df.groupBy(F.col(bucket).alias("__b")).agg(F.count("*").alias("__size"))
        rows = rows.join(F.broadcast(sizes), F.col(bucket).eqNullSafe(F.col("__b"))).filter(F.col("batch_id") < F.floor(F.col("__size") / size)).drop("__b", "__size")
    return rows.drop("__n")


def batch_positions(batches: DataFrame, bucket: str, batch: str, epoch: int = 0, seed: int = 42) -> DataFrame:
    """(bucket, batch, position): the batches of all buckets in the random order of an epoch, from 1 on, the same on every run."""
    each = batches.select(bucket, batch).distinct()
    return ranked(each.withColumn("__key", F.concat_ws("/", F.col(bucket).cast("string"), F.col(batch).cast("string"))), shuffle_key(F.col("__key"), seed + epoch), "__key", name="position").drop("__key")


def dataset_stats(pairs: DataFrame) -> DataFrame:
    """One row: count, mean and greatest length of either side in characters, and mean words of the target."""
    a, b = F.length("src"), F.length("tgt")
    return pairs.agg(F.count("*").alias("n"), F.avg(a).alias("avg_src"), F.avg(b).alias("avg_tgt"), F.max(a).alias("max_src"), F.max(b).alias("max_tgt"), F.avg(word_count(F.col("tgt"))).alias("avg_tgt_words"))
