"""Mixing real and synthetic pairs, and word-level augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.order import ranked, shuffle_key


def mix_synthetic(real: DataFrame, synthetic: DataFrame, ratio: float, key: str = "pair_id", seed: int = 42) -> DataFrame:
    """real and floor(real * ratio) synthetic rows, chosen at random, with is_synthetic. Columns are those of real.

    Chosen are the first ranks of a random order, which are counted in ranges of it.
    """
    need = real.agg(F.floor(F.count("*") * F.lit(float(ratio))).alias("__need"))
    placed = ranked(synthetic, shuffle_key(F.col(key), seed), key, name="__rank")
    some = placed.crossJoin(F.broadcast(need)).filter("__rank <= __need")  # one row
    return real.withColumn("is_synthetic", F.lit(False)).unionByName(some.select(*real.columns).withColumn("is_synthetic", F.lit(True)))


def mix_stats(mixed: DataFrame) -> DataFrame:
    """One row: total, real, synthetic, and synthetic rows over real ones (1 at least)."""
    out = mixed.agg(F.count("*").alias("total"), F.count_if(~F.col("is_synthetic")).alias("real"), F.count_if("is_synthetic").alias("synthetic"))
    return out.withColumn("ratio", F.col("synthetic") / F.greatest("real", F.lit(1)))


def iterative_union(base: DataFrame, synthetic: DataFrame, rounds: int, most: int, key: str = "pair_id") -> DataFrame:
    """base, and in each round the same first most // rounds synthetic rows: iteration is 0 for base."""
    part = synthetic.orderBy(key).limit(most // rounds)
    again = part.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return base.withColumn("iteration", F.lit(0)).unionByName(again)


def back_translate(df: DataFrame, translate: Callable[[list[str]], list[tuple[str, float]]], text: str = "tgt", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, src, tgt, confidence) by a callable from texts to translations and scores, in Arrow batches; the model is the caller's.

    tgt is the text itself, src what the callable makes of it; keep are columns that go with it. A null text isn't translated.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = translate(part["__text"].tolist())
            made = {"src": [x[0] for x in found], "tgt": part["__text"].tolist(), "confidence": [float(x[1]) for x in found]}
            yield pd.concat([part[list(keep)].reset_index(drop=True), pd.DataFrame(made)], axis=1)

    rows = df.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return rows.mapInPandas(run, schema)


def _unit(key: Column, *more: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    parts = F.concat_ws(":", key.cast("string"), *[F.lit(m) if isinstance(m, str) else m.cast("string") for m in more])
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def swap_words(words: Column, key: Column, p: float = 0.1) -> Column:
    """With probability p one pair of neighbours changes places; words: an array. Fewer than two stay."""
    at = F.floor(_unit(key, "at") * (F.size(words) - 1)).cast("int") + 1
    swapped = F.concat(F.slice(words, F.lit(1), at - 1), F.array(F.element_at(words, at + 1), F.element_at(words, at)), F.slice(words, at + 2, F.size(words)))
    return F.when((F.size(words) >= 2) & (_unit(key, "swap") < p), swapped).otherwise(words)


def drop_words(words: Column, key: Column, p: float = 0.1) -> Column:
    """Each word goes with probability p; the first stays if none would. Fewer than three stay as they are."""
    kept = F.filter(words, lambda w, i: _unit(key, i) >= p)
    return F.when(F.size(words) < 3, words).when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 1))
