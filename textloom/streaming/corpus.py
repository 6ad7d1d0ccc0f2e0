"""Cleaning, filtering and statistics over streams, with the Column builders of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import pair_hash
from textloom.operators.cleaning import CleaningRules, normalized, validated
from textloom.operators.filtering import FilterRules, filter_pipeline
from textloom.sources.readers import pair_schema


def read_pairs(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of (src, tgt, source) from JSON lines in a folder."""
    rows = spark.readStream.schema(pair_schema()).option("maxFilesPerTrigger", files).json(path)
    return rows.select(F.coalesce("chinese", F.lit("")).alias("src"), F.coalesce("english", F.lit("")).alias("tgt"), "source")


def clean(stream: DataFrame, rules: CleaningRules = CleaningRules(), full: bool = False, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Normalised and valid pairs, each once.

    Without a bound the hashes of all pairs are state; with event_time and within, pairs that come again after
    that time are new, and the state is bounded.
    """
    rows = validated(normalized(stream, full), rules).filter("reject_reason = 'valid'").drop("reject_reason")
    rows = rows.withColumn("pair_hash", pair_hash(F.col("src"), F.col("tgt")))
    if event_time and within:
        return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["pair_hash"]).drop("pair_hash")
    return rows.dropDuplicates(["pair_hash"]).drop("pair_hash")


def filtered(stream: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    """The batch filters; no state."""
    return filter_pipeline(stream, rules)


def rolling_stats(requests: DataFrame, at: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, group, n, mean): requests by time window; those later than `late` are left out and closed windows leave the state."""
    rows = requests.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = rows.groupBy(F.window("__at", window).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), group, "n", "mean")


def with_batch_stats(stream: DataFrame, path: str, checkpoint: str, stats: Callable[[DataFrame], DataFrame], stats_path: str) -> StreamingQuery:
    """Write a stream as JSON lines, and a row of statistics for each micro-batch. Runs until what is there has been read."""

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.write.mode("append").json(path)
        stats(kept).withColumn("batch", F.lit(number)).coalesce(1).write.mode("append").json(stats_path)
        kept.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Run a stream over what is there, into files."""
    stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
