"""Scores and classes of pairs as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import word_count

#: Similarity where there is no model to compute one.
DEFAULT_SIMILARITY = 0.8


def ratio(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """a / b, and `zero` where b is 0: filters take 0, the cleaner null (rejected), the sampler 1."""
    return F.when(b > 0, a / b).otherwise(F.lit(zero).cast("double"))


def length_ratio(src: Column, tgt: Column, zero: float | None = 0.0) -> Column:
    return ratio(F.length(src), F.length(tgt), zero)


def fallback_similarity(src: Column, tgt: Column) -> Column:
    """Characters of the source against words of the target: the smaller over the larger, 0 if both are 0."""
    a, b = F.length(src), word_count(tgt)
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def similarity_or_default(similarity: Column) -> Column:
    return F.coalesce(similarity, F.lit(DEFAULT_SIMILARITY))


def average_length(src: Column, tgt: Column) -> Column:
    """Mean of the source's characters and the target's words."""
    return (F.length(src) + word_count(tgt)) / 2


def filter_difficulty(src: Column, tgt: Column, similarity: Column) -> Column:
    avg = average_length(src, tgt)
    return F.when((avg < 30) & (similarity >= 0.85), "easy").when((avg < 80) & (similarity >= 0.7), "medium").otherwise("hard")


def length_group(src: Column, tgt: Column) -> Column:
    avg = average_length(src, tgt)
    return F.when(avg < 30, "short").when(avg < 80, "medium").otherwise("long")


def sampler_difficulty(src: Column, tgt: Column) -> Column:
    avg, r = average_length(src, tgt), ratio(F.length(src), word_count(tgt), 1.0)
    return F.when((avg < 25) & r.between(0.5, 2), "easy").when((avg >= 100) | (r < 0.3) | (r > 3), "hard").otherwise("medium")


def difficulty_score(length: Column, similarity: Column, oov: Column) -> Column:
    """0.4 * length (full at 100) + 0.4 * dissimilarity + 0.2 * unknown characters."""
    return F.lit(0.4) * F.least(length / 100, F.lit(1.0)) + F.lit(0.4) * (1 - similarity) + F.lit(0.2) * oov


def difficulty_level(score: Column) -> Column:
    return F.when(score < 0.3, "easy").when(score < 0.6, "medium").otherwise("hard")


def noam_rate(step: Column, d_model: int = 512, warmup: int = 4000, factor: float = 1.0) -> Column:
    """Learning rate of a step from 1 on: rises for warmup steps, then falls with the root of the step."""
    s = step.cast("double")
    return F.lit(float(factor) * d_model**-0.5) * F.least(1 / F.sqrt(s), s * F.lit(warmup**-1.5))


def confidence(sequence_score: Column) -> Column:
    return F.coalesce(F.exp(sequence_score), F.lit(1.0))


def share_of_max(value: Column, most: Column) -> Column:
    """value / most in per cent; 0 where most is 0."""
    return F.when(most > 0, value / most * 100).otherwise(0.0)
