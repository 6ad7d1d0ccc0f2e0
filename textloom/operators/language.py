"""Language identification by trigrams of letters: log-odds that Spark counts from labelled texts, and sums of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise

#: Trigrams of a model: the most frequent ones, so that it may be sent to every task.
GRAMS = 20_000
#: Weights are integers, thousandths of a natural logarithm, so a sum doesn't depend on its order.
UNIT = 1000
LANGUAGES = 256
#: Texts that are scored at once.
TOGETHER = 256


@dataclass(frozen=True)
class Model:
    """languages in order; weights (gram, w: one integer for each language); unknown: the integers of any other trigram."""

    languages: list[str]
    weights: DataFrame
    unknown: list[int]


def _grams(word: Column) -> Column:
    """The trigrams of a word with a space before and after it."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> Model:
    """Weights of trigrams by language, from labelled texts; null texts and languages are left out.

    The weight of a trigram in a language is 1000 * ln((n + 1) / (N + grams)), rounded, of n of its N trigrams. Words are
    counted before they are cut, so what is shuffled are distinct words. Kept are the most frequent trigrams of all languages
    together, ties by trigram.
    """
    words = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_words(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialise(words.select("lang", F.explode(_grams(F.col("word"))).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(totals)
    top = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(grams).select("gram")
    weight = lambda n, total: F.round(UNIT * F.log((n + 1) / F.lit(float(total + grams)))).cast("long")
    own = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages]
    weights = counts.join(F.broadcast(top), "gram").groupBy("gram").agg(F.array(*[weight(n, totals[x]) for n, x in zip(own, languages)]).alias("w"))
    unknown = docs.sparkSession.range(1).select(*[weight(F.lit(0), totals[x]).alias(f"w{i}") for i, x in enumerate(languages)]).first()
    return Model(languages, materialise(weights, "weights"), list(unknown))


def _scores(model: Model):
    """Texts of words of letters with single spaces between: the number of trigrams, one around each letter, and their sum of weights for each language."""
    rows, languages = model.weights.collect(), len(model.languages)
    known = np.array([_key(*map(ord, r.gram)) for r in rows], np.uint64)
    order = np.argsort(known)
    known = known[order]
    weights = np.array([*[rows[i].w for i in order.tolist()], model.unknown], np.int64).reshape(len(rows) + 1, languages)

    def sums(texts: list[str | None]) -> list[np.ndarray]:
        lengths = [len(t or "") + 1 for t in texts]
        codes = np.frombuffer((" " + "".join((t or "") + " " for t in texts)).encode("utf-32-le"), "<u4").astype(np.uint64)
        at = np.flatnonzero(codes[1:] != ord(" ")) + 1
        of = np.repeat(np.arange(len(texts)), lengths)[at - 1]
        grams = _key(codes[at - 1], codes[at], codes[at + 1])
        place = np.searchsorted(known, grams)
        if len(known):
            place[known[np.minimum(place, len(known) - 1)] != grams] = len(known)
        # Sums of whole numbers far below 2 ** 53.
        return [np.bincount(of, minlength=len(texts)), *[np.bincount(of, weights[place, i], len(texts)).astype(np.int64) for i in range(languages)]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "grams", *[f"s{i}" for i in range(languages)]]
        for part in parts:
            for i in range(0, len(part), TOGETHER):
                few = part.slice(i, TOGETHER)
                yield pa.RecordBatch.from_arrays([few.column(0), *map(pa.array, sums(few.column(1).to_pylist()))], names=names)

    return run


def _key(a, b, c):
    """Three code points as one number; numbers or arrays of them."""
    return a << 42 | b << 21 | c


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, grams, language, margin): a row for each key, the language with the greatest sum of weights, and how much it leads the next.

    Ties go to the first language by name. A text without letters has no language and a margin of 0. The model has a bounded
    number of trigrams and languages and goes to every task; texts aren't moved, only their sums are; trigrams are never rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [f"s{i}" for i in range(len(model.languages))]
    letters = F.regexp_replace(F.lower(F.col(text)), r"\P{L}+", " ")
    found = docs.select(F.col(key).alias("key"), letters.alias("letters")).mapInArrow(_scores(model), f"key {kind}, grams long" + "".join(f", {n} long" for n in names))
    totals = found.groupBy("key").agg(*[F.sum(n).alias(n) for n in ["grams", *names]])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"s{i}")).alias("s"), F.lit(x).alias("lang")) for i, x in enumerate(model.languages)]))
    best, lead = ranked[0], (F.get(ranked, F.lit(1))["s"] - ranked[0]["s"] if len(model.languages) > 1 else F.lit(0))
    some = F.col("grams") > 0
    return totals.select(F.col("key").alias(key), "grams", F.when(some, best["lang"]).alias("language"), F.when(some, lead).otherwise(0).alias("margin"))
