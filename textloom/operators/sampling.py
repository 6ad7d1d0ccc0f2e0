"""Sampling of high-quality pairs: strata by difficulty and length, a cap for each similarity bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import fallback_similarity, length_group, sampler_difficulty
from textloom.functions.text import word_count
from textloom.operators.order import numbered, ranked, shuffle_key


@dataclass(frozen=True)
class SamplerRules:
    #: None: as many as there are.
    target: int | None = 300_000
    min_similarity: float = 0.75
    max_length: int = 128
    min_length: int = 3
    bucket_width: float = 0.05


def prefiltered(pairs: DataFrame, rules: SamplerRules = SamplerRules()) -> DataFrame:
    src, tgt = F.col("src"), F.col("tgt")
    return pairs.filter((F.length(src) <= rules.max_length) & (word_count(tgt) <= rules.max_length) & (F.length(F.trim(src)) >= rules.min_length) & (F.length(F.trim(tgt)) >= rules.min_length))


def with_metadata(pairs: DataFrame, similarity: Column | None = None) -> DataFrame:
    """pairs with similarity_score, difficulty, length_group and domain_type."""
    src, tgt = F.col("src"), F.col("tgt")
    s = fallback_similarity(src, tgt) if similarity is None else similarity
    return pairs.withColumns({"similarity_score": s, "difficulty": sampler_difficulty(src, tgt), "length_group": length_group(src, tgt), "domain_type": F.lit("general")})


def sample_ids(df: DataFrame, order: str = "pair_id") -> DataFrame:
    """df with id, sample_ and eight digits, by position in the order of a column. Positions are counted in ranges of that order."""
    return numbered(df, order, name="__pos").withColumn("id", F.format_string("sample_%08d", F.col("__pos") - 1)).drop("__pos")


def stratified(df: DataFrame, target: int, order: str = "pair_id") -> DataFrame:
    """target rows: of each stratum the best, as many as its share, then the best of what is left.

    The share is target // strata, 1 at least. Rows within it come first, then by similarity; the first target of that
    order stay, so too many strata are trimmed by similarity. Empty input gives an empty result.
    """
    first = [F.desc("similarity_score"), F.col(order)]
    strata = df.select("difficulty", "length_group").distinct().agg(F.count("*").alias("__strata"))
    rank = F.row_number().over(Window.partitionBy("difficulty", "length_group").orderBy(*first))
    # No stratum gives more than target rows, which limits each before the exchange.
    rows = df.withColumn("__n", rank).filter(F.col("__n") <= target).crossJoin(F.broadcast(strata))
    late = F.col("__n") > F.greatest(F.floor(F.lit(target) / F.greatest(F.col("__strata"), F.lit(1))), F.lit(1))
    # Ranks of the whole order are counted in ranges of it, so the rows that stay are never one task's.
    placed = numbered(rows.withColumns({"__late": late, "__worse": F.coalesce(-F.col("similarity_score"), F.lit(float("inf")))}), "__late", "__worse", order, name="__pos")
    return placed.filter(F.col("__pos") <= target).drop("__n", "__strata", "__late", "__worse", "__pos")


def similarity_bucket(similarity: Column, width: float = 0.05) -> Column:
    return F.floor(similarity / width).cast("int")


def bucket_capped(df: DataFrame, width: float = 0.05, seed: int = 42, order: str = "pair_id", refill: int | None = None) -> DataFrame:
    """Of each similarity bucket at most rows // buckets, 1 at least, chosen at random but the same on every run.

    With refill, and that many rows or more in df, rows that the cap leaves out come back in random order until there are so many.
    """
    rows = df.withColumn("bucket", similarity_bucket(F.col("similarity_score"), width))
    size = rows.agg(F.count("*").alias("__rows"), F.count_distinct("bucket").alias("__buckets"))
    cap = F.greatest(F.floor(F.col("__rows") / F.greatest(F.col("__buckets"), F.lit(1))), F.lit(1))
    rows = ranked(rows, shuffle_key(F.col(order), seed), order, ["bucket"], "__n")
    rows = rows.crossJoin(F.broadcast(size)).withColumn("__kept", F.col("__n") <= cap)
    if refill is None:
        return rows.filter("__kept").drop("__n", "__rows", "__buckets", "__kept")
    # What is kept comes first, the rest after it in its own random order; the first `refill` of that stay, or all that is kept.
    turn = F.concat(F.when(F.col("__kept"), "0").otherwise("1"), shuffle_key(F.col(order), seed + 1))
    placed = ranked(rows, turn, order, name="__turn")
    back = (F.col("__turn") <= refill) & (F.col("__rows") >= refill)
    return placed.filter(F.col("__kept") | back).drop("__n", "__rows", "__buckets", "__kept", "__turn")


def best(df: DataFrame, target: int, order: str = "pair_id") -> DataFrame:
    """The target rows of the greatest similarity, ties by order. Ranks are counted in ranges, so the rows that stay are never one task's."""
    placed = numbered(df.withColumn("__worse", F.coalesce(-F.col("similarity_score"), F.lit(float("inf")))), "__worse", order, name="__pos")
    return placed.filter(F.col("__pos") <= target).drop("__worse", "__pos")


def high_quality_sample(pairs: DataFrame, rules: SamplerRules = SamplerRules(), similarity: Column | None = None, diverse: bool = False, strata: bool = True) -> DataFrame:
    """Prefilter, metadata, quality threshold, strata; diverse: then a cap for each similarity bucket, refilled to the target.

    Without strata the best of all rows are chosen; without a target all rows are, and what the cap leaves out stays out.
    """
    good = with_metadata(prefiltered(pairs, rules), similarity).filter(F.col("similarity_score") >= rules.min_similarity)
    chosen = good if rules.target is None else stratified(good, rules.target) if strata else best(good, rules.target)
    return bucket_capped(chosen, rules.bucket_width, refill=rules.target).drop("bucket") if diverse else chosen


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, unknown for null."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
