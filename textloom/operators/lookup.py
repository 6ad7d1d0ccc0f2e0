"""Terminology and cache lookups as joins."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.functions.text import cache_key, term_line

#: Terms and characters of a glossary that one automaton takes; larger glossaries are cut into blocks of so much.
MOST_TERMS, MOST_CHARS = 500_000, 16 << 20


def _finder(needles: list[tuple[str, int]]):
    """A function of a column of texts to the sorted numbers of the needles in each, by one pass over it."""

    @F.pandas_udf("array<int>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for needle, number in needles:
            automaton.add_word(needle, [*automaton.get(needle, ()), number])
        automaton.make_automaton()
        for texts in parts:
            yield texts.map(lambda t: sorted({n for _, numbers in automaton.iter(t) for n in numbers}) if t else [])

    return found


def _blocks(rows: list[Row]) -> Iterator[list[Row]]:
    block, chars = [], 0
    for r in rows:
        size = len(r.source or "") + len(r.target or "")
        if block and (len(block) == MOST_TERMS or chars + size > MOST_CHARS):
            yield block
            block, chars = [], 0
        block.append(r)
        chars += size
    if block:
        yield block


def match_terms(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(text columns, term columns) for each term whose source or target a text contains.

    terms: term_id, source, target. All terms are searched at once by an automaton in each task, one pass over the texts
    however many there are, and only matches become rows; no text is moved. A glossary goes to the driver in parts of checked
    size, MOST_TERMS terms or MOST_CHARS characters, each an automaton of its own. A null text or name of a term
    contains and matches nothing, an empty name matches every text that isn't null. Repeated terms match each.
    """
    spark, slim = texts.sparkSession, terms.select("term_id", "source", "target")
    parts = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(F.length("source"), F.lit(0)) + F.coalesce(F.length("target"), F.lit(0))), F.lit(0)).alias("chars")).first()
    shares = 1 + max(parts.n * 2 // MOST_TERMS, parts.chars * 2 // MOST_CHARS)
    kind = StructType([StructField("__number", IntegerType()), *[StructField(n, slim.schema[c].dataType) for n, c in (("term_id", "term_id"), ("term_source", "source"), ("term_target", "target"))]])
    out = None
    for share in range(shares):
        rows = slim.filter(F.pmod(F.xxhash64("term_id"), F.lit(shares)) == share).collect() if shares > 1 else slim.collect()
        for block in _blocks(rows):
            needles = [(name, i) for i, r in enumerate(block) for name in {r.source, r.target} if name]
            always = [i for i, r in enumerate(block) if r.source == "" or r.target == ""]
            hits = _finder(needles)(F.col(text))
            if always:
                hits = F.array_union(hits, F.array(*map(F.lit, always)))
            hits = F.when(F.col(text).isNotNull(), hits)
            of = spark.createDataFrame([(i, r.term_id, r.source, r.target) for i, r in enumerate(block)], kind)
            found = texts.withColumn("__number", F.explode(hits)).join(of, "__number").drop("__number")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.join(spark.createDataFrame([], StructType(kind.fields[1:])), F.lit(False))
    return out


def glossary_prompt(matches: DataFrame, key: str) -> DataFrame:
    """(key, prompt): a line for each matched term, by id."""
    line = F.struct("term_id", term_line(F.col("term_source"), F.col("term_target")).alias("line"))
    return matches.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["line"]), "\n").alias("prompt"))


def search_terms(terms: DataFrame, needle: str, category: str = "all") -> DataFrame:
    """Terms with needle in source, target or note, of a category or of all."""
    hit = F.contains(F.col("source"), F.lit(needle)) | F.contains(F.col("target"), F.lit(needle)) | F.coalesce(F.contains(F.col("note"), F.lit(needle)), F.lit(False))
    return terms.filter(hit & ((F.lit(category) == "all") | (F.col("category") == category)))


def exact_lookup(queries: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """queries with value from cache (key, value) by the MD5 of the text; null where there is none."""
    return queries.withColumn("__key", cache_key(F.col(text))).join(cache.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def longest_prefix(queries: DataFrame, cache: DataFrame, key: str, text: str = "text", most: int = 50) -> DataFrame:
    """(key, prefix, value): of the cached texts (prefix, value) that begin the query's first `most` characters the longest.

    A query gives a row for each length that a cached text has, at most `most` of them, and these join by equality. key tells
    queries apart; an empty text has no prefix.
    """
    # At most `most` numbers.
    lengths = sorted(r.n for r in cache.select(F.length("prefix").alias("n")).filter(F.col("n").between(1, most)).distinct().collect())
    cut = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(text))
    prefixes = F.transform(cut, lambda n: F.substring(F.col(text), F.lit(1), n))
    hits = queries.select(key, F.explode(prefixes).alias("prefix")).join(cache, "prefix")
    best = F.max_by(F.struct("prefix", "value"), F.length("prefix"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.prefix", "b.value")


def with_default(left: DataFrame, right: DataFrame, on: str, value: str, default: float = 0.0) -> DataFrame:
    """left with value from right, or the default."""
    return left.join(right.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def positional(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at the same position; the longer side's rest goes."""
    return left.join(right, pos)


def without(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't selected."""
    return df.join(selected.select(key), key, "left_anti")


def union_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The different keys of either side; null is a key."""
    return left.select(key).unionByName(right.select(key)).distinct()


def vocabulary_misses(text: Column, vocabulary: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, misses, n): characters, with repeats, that a vocabulary (char) of any size lacks."""
    chars = rows.select(key, F.explode(F.split(text, "")).alias("char")).groupBy(key, "char").agg(F.count("*").alias("n"))
    known = vocabulary.select("char").distinct().withColumn("known", F.lit(True))
    return chars.join(known, "char", "left").groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("misses"), F.sum("n").alias("n"))
