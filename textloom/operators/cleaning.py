"""Cleaning: a cascade of checks of which the first that fails counts, and exact deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import cjk_count, clean_text, collapse_space, pair_hash


@dataclass(frozen=True)
class CleaningRules:
    """Limits, all inclusive. With check_language, src needs half of min_src Han characters and tgt_language must be en."""

    min_src: int = 5
    max_src: int = 200
    min_tgt: int = 10
    max_tgt: int = 500
    min_ratio: float = 0.1
    max_ratio: float = 0.8
    check_language: bool = False


def reject_reason(src: Column, tgt: Column, rules: CleaningRules = CleaningRules(), tgt_language: Column | None = None) -> Column:
    """empty, zh_length, en_length, ratio, zh_lang, en_lang, or valid: the first that holds."""
    a, b = F.length(src), F.length(tgt)
    out = (
        F.when(F.coalesce(F.trim(src) == "", F.lit(True)) | F.coalesce(F.trim(tgt) == "", F.lit(True)), "empty")
        .when(~a.between(rules.min_src, rules.max_src), "zh_length")
        .when(~b.between(rules.min_tgt, rules.max_tgt), "en_length")
        .when(~(a / F.greatest(b, F.lit(1))).between(rules.min_ratio, rules.max_ratio), "ratio")
    )
    if rules.check_language:
        out = out.when(cjk_count(src) < 0.5 * rules.min_src, "zh_lang")
        if tgt_language is not None:
            out = out.when(tgt_language != "en", "en_lang")
    return out.otherwise("valid")


def normalized(pairs: DataFrame, full: bool = False) -> DataFrame:
    """Both sides cleaned: white space only, or all steps."""
    f = clean_text if full else collapse_space
    return pairs.withColumns({c: f(F.col(c)) for c in ("src", "tgt")})


def validated(pairs: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    return pairs.withColumn("reject_reason", reject_reason(F.col("src"), F.col("tgt"), rules))


def reason_counts(validated_pairs: DataFrame) -> DataFrame:
    return validated_pairs.groupBy("reject_reason").agg(F.count("*").alias("n"))


def deduplicated(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """The first pair in order of each pair hash.

    Each task keeps the first of its own before anything is dealt out, so copies of one pair meet as one row a task.
    """
    rows = pairs.withColumn("__h", pair_hash(F.col("src"), F.col("tgt")))
    return first_by(rows, ["__h"], order).drop("__h")


def clean(pairs: DataFrame, rules: CleaningRules = CleaningRules(), full: bool = False) -> DataFrame:
    """Normalised, valid, and each pair once."""
    kept = validated(normalized(pairs, full), rules).filter("reject_reason = 'valid'").drop("reject_reason")
    return deduplicated(kept)


def cleaning_stats(pairs: DataFrame, rules: CleaningRules = CleaningRules(), full: bool = False) -> DataFrame:
    """One row: total, filtered by group of reasons, duplicates, html_cleaned, final and the retention rate in per cent."""
    rows = validated(normalized(pairs, full), rules)
    html = F.col("src").rlike("<[^>]+>") | F.col("tgt").rlike("<[^>]+>")
    has = lambda *r: F.count_if(F.col("reject_reason").isin(*r))
    counts = rows.agg(
        F.count("*").alias("total"),
        has("zh_length", "en_length").alias("length_filtered"),
        has("ratio").alias("ratio_filtered"),
        has("zh_lang", "en_lang").alias("language_filtered"),
        has("empty").alias("empty_filtered"),
        has("valid").alias("valid"),
    )
    hashes = rows.filter("reject_reason = 'valid'").select(pair_hash(F.col("src"), F.col("tgt")).alias("h")).distinct().agg(F.count("*").alias("final"))
    cleaned = pairs.agg(F.count_if(html).alias("html_cleaned"))
    out = counts.crossJoin(F.broadcast(hashes)).crossJoin(F.broadcast(cleaned))
    return out.select("total", "length_filtered", "ratio_filtered", "language_filtered", "empty_filtered", (F.col("valid") - F.col("final")).alias("duplicates"), "html_cleaned", "final", F.coalesce(F.try_divide(F.col("final") * 100.0, F.col("total")), F.lit(0.0)).alias("retention_rate"))


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def non_zero(counts: DataFrame, n: str) -> DataFrame:
    """counts without reasons that no row has, as charts show them."""
    return counts.filter(F.col(n) > 0)
