"""The tables at hand as pairs, terms, requests and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a document, at most, for pair_id to order pairs by document and line.
LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes that a task should have at least before a source is dealt out to more of them.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small source in fewer parts than there are cores is dealt out to all of them; a larger one stays as it is read.

    Small files have one row group, which one task reads. What counts is the plan's size, so large sources are never shuffled
    for this; projections and filters still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * min(cores, 64) else df


def pairs_lines(documents: DataFrame) -> DataFrame:
    """(pair_id, src, tgt, source): each line of a document with the next. Made inside a row: nothing is shuffled."""
    lines = F.split("text", "\n")
    steps = F.sequence(F.lit(1), F.greatest(F.size("l") - 1, F.lit(1)))
    pair = F.transform(steps, lambda i: F.struct((F.col("doc_id") * LINES + i - 1).alias("pair_id"), F.element_at("l", i).alias("src"), F.try_element_at("l", i + 1).alias("tgt")))
    rows = documents.select("doc_id", "source", lines.alias("l")).filter(F.size("l") > 1)
    return rows.select(F.explode(pair).alias("p"), "source").select("p.pair_id", "p.src", "p.tgt", "source")


def pairs_conversations(conversations: DataFrame) -> DataFrame:
    """(pair_id, src, tgt, source): each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("tgt"))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * LINES + F.col("turn")).alias("pair_id"), F.col("text").alias("src"), "tgt", F.lit("conversations").alias("source"))


def terms(benchmark: DataFrame) -> DataFrame:
    """(term_id, source, target, note, category): the first two words of a passage, and its third."""
    w = F.split("text", " ")
    category = F.element_at(F.array(*[F.lit(c) for c in ("general", "tech", "law", "medicine", "finance", "science", "other")]), (F.col("item_id") % 7 + 1).cast("int"))
    return benchmark.select(F.col("item_id").alias("term_id"), F.array_join(F.slice(w, 1, 2), " ").alias("source"), F.array_join(F.slice(w, 3, 2), " ").alias("target"), F.substring("text", 1, 40).alias("note"), category.alias("category"))


def requests(events: DataFrame) -> DataFrame:
    """(request_id, ts, user_id, key, latency): events as requests to a cache, keyed by type and user."""
    return events.select(F.col("event_id").alias("request_id"), "ts", "user_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("value").alias("latency"), "event_type")


def loss_log(events: DataFrame) -> DataFrame:
    """(run, step, loss): each user's events in order as a training log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("step"), F.col("value").alias("loss"))


def eval_runs(part: DataFrame) -> DataFrame:
    """(dataset, model, quality, latency, size): parts by type and brand as evaluated models.

    Prices are summed in cents and sizes as integers, so a mean doesn't depend on the order of rows.
    """
    cents, size = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size").cast("long")
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    return part.groupBy(F.col("p_type").alias("dataset"), F.col("p_brand").alias("model")).agg(
        (mean(cents) / 5000).alias("quality"), mean(size).alias("latency"), F.sum(size).cast("double").alias("size")
    )


def hyp_ref(documents: DataFrame) -> DataFrame:
    """(row_id, hyp, ref): a line, and the line without the words whose hash ends in 0. Lines without words are left out."""
    lines = F.split("text", "\n")
    # A line has words if it isn't all spaces; asking for words here would split each line once more.
    rows = documents.select("doc_id", F.posexplode(lines).alias("pos", "line")).filter(F.trim("line") != "")
    words = F.filter(F.split("line", " "), lambda w: w != "")
    kept = F.filter("w", lambda w, i: ~F.md5(F.concat_ws(":", F.col("row_id").cast("string"), i.cast("string")).cast("binary")).endswith("0"))
    rows = rows.select((F.col("doc_id") * LINES + F.col("pos")).alias("row_id"), words.alias("w"))
    return rows.select("row_id", F.array_join(kept, " ").alias("hyp"), F.array_join("w", " ").alias("ref"))
