"""Filters by length ratio, repetition and similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import repeat_ratio
from textloom.functions.scores import fallback_similarity, filter_difficulty, length_ratio
from textloom.functions.text import tokens


@dataclass(frozen=True)
class FilterRules:
    min_ratio: float = 0.25
    max_ratio: float = 0.5
    max_repeat: float = 0.3
    min_similarity: float = 0.7


def ratio_filter(pairs: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    """pairs with length_ratio, within the limits."""
    return pairs.withColumn("length_ratio", length_ratio(F.col("src"), F.col("tgt"))).filter(F.col("length_ratio").between(rules.min_ratio, rules.max_ratio))


def repeat_filter(pairs: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    """Pairs of which no side has more than the allowed share of repeated trigrams."""
    high = lambda c: repeat_ratio(tokens(F.col(c))) > rules.max_repeat
    return pairs.filter(~high("src") & ~high("tgt"))


def similarity_filter(pairs: DataFrame, similarity: Column, rules: FilterRules = FilterRules()) -> DataFrame:
    return pairs.withColumn("similarity_score", similarity).filter(F.col("similarity_score") >= rules.min_similarity)


def filter_pipeline(pairs: DataFrame, rules: FilterRules = FilterRules(), similarity: Column | None = None) -> DataFrame:
    """Cheap filters first, then similarity, and a difficulty for what is left.

    similarity: a column, such as a model's UDF; without one lengths stand in. It is a filter of its own after the
    others, so a UDF only sees rows that passed them.
    """
    s = fallback_similarity(F.col("src"), F.col("tgt")) if similarity is None else similarity
    kept = similarity_filter(repeat_filter(ratio_filter(pairs, rules), rules), s, rules)
    return kept.withColumn("difficulty", filter_difficulty(F.col("src"), F.col("tgt"), F.col("similarity_score")))


def ordered_head(pairs: DataFrame, target: int, order: str = "pair_id") -> DataFrame:
    """Exactly the first target rows that passed."""
    return pairs.orderBy(order).limit(target)


def difficulty_filter(df: DataFrame, max_length: int, min_confidence: float) -> DataFrame:
    """Rows with a source of at most max_length and a similarity, 0.8 if unknown, of at least min_confidence."""
    return df.filter((F.length("src") <= max_length) & (F.coalesce("similarity_score", F.lit(0.8)) >= min_confidence))


def synthetic_filter(df: DataFrame, min_confidence: float = 0.7, low: float = 1 / 3, high: float = 3.0) -> DataFrame:
    """Synthetic pairs (src, tgt, confidence) that are sure enough and of like length."""
    r = F.length("src") / F.greatest(F.length("tgt"), F.lit(1))
    return df.filter((F.col("confidence") >= min_confidence) & r.between(low, high))
