"""Tokenisation reports, word frequencies, and encoding by a tokenizer of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import wmt_normalize, words


def token_report(tokens: Column, df: DataFrame) -> DataFrame:
    """One row: texts, tokens, and mean, least and greatest tokens of a text; zeros for no texts."""
    n = F.size(tokens)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.agg(F.count("*").alias("texts"), zero(F.sum(n)).alias("tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"), zero(F.min(n)).cast("long").alias("least"), zero(F.max(n)).cast("long").alias("most"))


def token_samples(df: DataFrame, tokens: Column, order: str, texts: int = 5, most: int = 20) -> DataFrame:
    """The first texts' first tokens, for a report."""
    return df.orderBy(order).limit(texts).select(order, F.slice(tokens, 1, most).alias("tokens"))


def compression_ratio(text: Column, tokens: Column) -> Column:
    """Characters for each token; 0 without tokens."""
    return F.coalesce(F.try_divide(F.length(text), F.size(tokens)), F.lit(0.0))


def word_frequencies(df: DataFrame, text: str, n: int = 30) -> DataFrame:
    """(word, n) of the n most frequent words, ties by word."""
    counts = df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(n)


def length_window(c: Column, least: int = 3, most: int = 128) -> Column:
    return F.length(c).between(least, most)


def preprocess_pairs(pairs: DataFrame, src_spaced: bool = True, tgt_spaced: bool = True, least: int = 3, most: int = 128) -> DataFrame:
    """Both sides normalised, pairs outside the length window left out."""
    rows = pairs.withColumns({"src": wmt_normalize(F.col("src"), src_spaced), "tgt": wmt_normalize(F.col("tgt"), tgt_spaced)})
    return rows.filter(length_window(F.col("src"), least, most) & length_window(F.col("tgt"), least, most))


def preprocess_encoded(pairs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[int]]]], src_spaced: bool = True, tgt_spaced: bool = True, least: int = 3, most: int = 128) -> DataFrame:
    """preprocess_pairs(), both sides encoded by the caller's tokenizer as src_ids and tgt_ids, and the window once more, on tokens.

    load() gives a function from texts to ids, and is called once in a task.
    """

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = load()
        for part in parts:
            yield pd.Series(of(part.tolist()))

    rows = preprocess_pairs(pairs, src_spaced, tgt_spaced, least, most)
    rows = rows.withColumns({"src_ids": ids(F.col("src")), "tgt_ids": ids(F.col("tgt"))})
    return within_token_limits(within_token_limits(rows, "src_ids", least, most), "tgt_ids", least, most)


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[int]]]], key: str) -> DataFrame:
    """(key, ids) by a tokenizer: load() gives a function from texts to ids, and is called once in a task. Null is empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = load()
        for part in parts:
            ids = of([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(df: DataFrame, load: Callable[[], Callable[[list[list[int]]], list[str]]], key: str) -> DataFrame:
    """(key, text) of (key, ids)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = load()
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of([x or [] for x in part.column(1).to_pylist()]), pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("long").alias(key), "ids").mapInArrow(run, f"{key} long, text string")


def within_token_limits(df: DataFrame, ids: str = "ids", least: int = 3, most: int = 128) -> DataFrame:
    return df.filter(F.size(ids).between(least, most))
