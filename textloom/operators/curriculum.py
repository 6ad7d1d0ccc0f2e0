"""Curricula: stages by difficulty, sets of an epoch, weights from losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import sampler_difficulty
from textloom.operators.order import ranked, shuffle_key

STAGES = ("easy", "medium", "hard")
#: Share of the epochs after which a stage ends.
STAGE_ENDS = (0.3, 0.7)
#: Greatest length and least similarity of each stage where no label is given.
STAGE_BOUNDS = {"easy": (50, 0.85), "medium": (100, 0.75), "hard": (10**9, 0.0)}


def stage_rank(stage: Column) -> Column:
    return F.when(stage == "easy", 0).when(stage == "medium", 1).otherwise(2)


def stage_of(pairs: DataFrame, label: str | None = None) -> DataFrame:
    """pairs with stage: a valid label wins, else the difficulty of the texts."""
    own = sampler_difficulty(F.col("src"), F.col("tgt"))
    return pairs.withColumn("stage", F.when(F.col(label).isin(*STAGES), F.col(label)).otherwise(own) if label else own)


def stage_of_epoch(epoch: Column, total: Column | int) -> Column:
    progress = epoch / (F.lit(total) if isinstance(total, int) else total)
    return F.when(progress < STAGE_ENDS[0], "easy").when(progress < STAGE_ENDS[1], "medium").otherwise("hard")


def active_counts(staged: DataFrame, total_epochs: int) -> DataFrame:
    """(epoch, stage, n): rows that are active in each epoch: its stage and those before.

    Where those hold no row, the next stage's come in, and at last all. Only counts of stages meet the epochs.
    """
    counts = staged.groupBy(stage_rank(F.col("stage")).alias("r")).agg(F.count("*").alias("n"))
    per = counts.agg(*[F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(3)])
    epochs = staged.sparkSession.range(total_epochs).select(F.col("id").alias("epoch"), stage_of_epoch(F.col("id"), total_epochs).alias("stage"))
    rank = stage_rank(F.col("stage"))
    n = F.when((rank == 0) & (F.col("c0") > 0), F.col("c0")).when((rank <= 1) & (F.col("c1") > 0), F.col("c1")).otherwise(F.col("c2"))
    return epochs.crossJoin(F.broadcast(per)).select("epoch", "stage", n.alias("n"))


def active_rows(staged: DataFrame, epoch: int, total_epochs: int, key: str, seed: int = 42) -> DataFrame:
    """The rows of an epoch in its own random order: df with position, from 1 on."""
    k = next((i for i, end in enumerate(STAGE_ENDS) if epoch / total_epochs < end), 2)
    for reach in range(k, 3):
        rows = staged.filter(stage_rank(F.col("stage")) <= reach)
        if reach == 2 or not rows.isEmpty():
            return ranked(rows, shuffle_key(F.col(key), seed + epoch), key, name="position")
    return staged


def curriculum_sets(pairs: DataFrame, label: str | None = None) -> DataFrame:
    """(stage, n): sizes of the cumulative sets, stages by label or by length and similarity (0.8 if unknown) against STAGE_BOUNDS."""
    s = F.coalesce("similarity_score", F.lit(0.8)) if "similarity_score" in pairs.columns else F.lit(0.8)
    own = F.lit("hard")
    for stage in reversed(STAGES[:-1]):
        length, similarity = STAGE_BOUNDS[stage]
        own = F.when((F.length("src") <= length) & (s >= similarity), stage).otherwise(own)
    rows = pairs.select((F.when(F.col(label).isin(*STAGES), F.col(label)).otherwise(own) if label else own).alias("stage"))
    counts = rows.groupBy("stage").agg(F.count("*").alias("n"))
    return counts.select("stage", F.sum("n").over(Window.orderBy(stage_rank(F.col("stage")))).alias("n"))


def softmax_weights(averages: DataFrame, value: str, temperature: float = 1.0) -> DataFrame:
    """averages with weight, the softmax over its rows; an average of 0 counts as 1. averages has a row for each difficulty."""
    every = Window.partitionBy(F.lit(0))
    v = F.when(F.col(value) == 0, 1.0).otherwise(F.col(value))
    e = F.exp((v - F.max(v).over(every)) / temperature)
    return averages.withColumn("__e", e).withColumn("weight", F.col("__e") / F.sum("__e").over(every)).drop("__e")


def dynamic_curriculum(losses: DataFrame, group: str, loss: str, total: int, temperature: float = 1.0) -> DataFrame:
    """(group, n, avg_loss, weight, take): how many of total rows each group gets by its mean loss, at most what it has."""
    averages = losses.groupBy(group).agg(F.count("*").alias("n"), F.avg(loss).alias("avg_loss"))
    out = softmax_weights(averages, "avg_loss", temperature)
    return out.withColumn("take", F.least(F.floor(F.col("weight") * total), F.col("n")))


def with_replacement(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement, the same on every run: draw i takes the row whose rank is a hash of i."""
    rows = ranked(df, shuffle_key(F.col(key), seed), key, name="__n")
    size = df.agg(F.count("*").alias("__size"))
    h = F.conv(F.substring(shuffle_key(F.col("draw"), seed), 1, 12), 16, 10).cast("long")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).filter("__size > 0").select("draw", (h % F.col("__size") + 1).alias("__n"))
    return draws.join(rows, "__n").drop("__n")
