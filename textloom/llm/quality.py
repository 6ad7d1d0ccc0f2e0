"""Quality rules: per-document rules, and lines that too many documents of a host share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._text import Words, _mixed, batches, rolling, row_key, small_batches
from textloom.session import materialise, temporary


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    A document fails by itself with fewer than min_words words, or more than max_repeat_percent of them in windows
    of `window` words that it has twice or more. A line is common to a host when more than max_line_share of the
    host's distinct documents have it, and more than min_line_documents of them. A document is depleted when
    fewer than min_kept_words words are left outside common lines, or less than min_kept_share of its words.
    """

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    max_line_share: float = 0.02
    min_line_documents: int = 3
    min_kept_words: int = 10
    min_kept_share: float = 0.3


#: Parts in which the rows of a common line are met, so that one in a third of a host's documents is no hot key.
SALTS = 32
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_MEASURED = "rid long, doc_id {kind}, host string, body long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"


def normalised_line(line: str) -> str:
    """Lower case, runs of white space as one space, digits as 0: the form in which lines are compared across documents."""
    return " ".join(line.lower().split()).translate(_DIGITS)


_DIGITS = {ord(c): "0" for c in "123456789"}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _measure(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS.encode())] = True
        for whole in parts:
            for a, b in batches(whole.column(3), 1 << 20):
                part = whole.slice(a, b - a)
                w = Words(part.column(3))
                n = len(part)
                sums = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
                counts = np.diff(w.first)
                chars = sums(w.inside & ((w.data & 0xC0) != 0x80), w.offsets)
                symbols = sums(symbol[w.data], w.offsets)
                doc = w.document()
                runs = rolling(w.hashes() ^ _mixed(doc.astype(np.uint64)), window)
                within = doc[: len(runs)] == doc[window - 1 :] if len(runs) else np.zeros(0, bool)
                at = np.flatnonzero(within)
                _, inverse, times = np.unique(runs[at], return_inverse=True, return_counts=True)
                twice = at[times[inverse] > 1]
                cover = np.zeros(len(w) + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + window, -1)
                repeated = sums(np.cumsum(cover[:-1]) > 0, w.first)
                again, lines, bodies = np.zeros(n, np.int64), [], []
                for i, text in enumerate(part.column(3).to_pylist()):
                    raw = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
                    again[i] = len(raw) - len(set(raw))
                    own: dict[int, int] = {}
                    for x in raw:
                        h = _hash(normalised_line(x))
                        own[h] = own.get(h, 0) + len(x.encode().split())
                    lines.append([{"h": h, "w": k} for h, k in own.items()])
                    bodies.append(_hash(text or ""))
                arrays = [pa.array(x, pa.int64()) for x in (bodies, counts, chars, symbols, again, repeated)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *arrays, pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))], names=["rid", "doc_id", "host", "body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    return run


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: doc_id, its counts, base_failed, n_common_words (in lines common to its host) and kept.

    Exact copies of a text count as one document of their host, so copies alone never make a line common. Lines are
    compared as 64-bit hashes of their normalised form; lines without a word don't count. A null text has no words
    and fails; documents with a null host form a host of their own. Every input row gives one row, also where ids
    repeat; an empty table gives an empty result.

    One pass over the texts writes counts and line hashes, a few per cent of the input; the rest joins those.
    """
    return _judged(docs, rules, F.col(id_col).cast("long"), "long", text_col, host_col).drop("common_lines")


def _judged(docs: DataFrame, rules: Rules, key: Column, kind: str, text_col: str, host_col: str) -> DataFrame:
    """judged() with key, of a type, as doc_id, and common_lines, the hashes of a document's common lines (null: none)."""
    small_batches(docs)
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), key.alias("doc_id"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    measured = materialise(slim.mapInArrow(_measure(rules.window), _MEASURED.format(kind=kind)), "quality")
    # A line in a document: two sums with partial aggregation, so that a line in a third of all documents is no hot key.
    lines = measured.select("rid", "host", "body", F.explode("lines").alias("line")).select("rid", "host", "body", "line.h", "line.w")
    spread = lines.groupBy("host", "h", "body").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n_documents"))
    hosts = measured.groupBy("host", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("n_host"))
    often = spread.filter(F.col("n_documents") > rules.min_line_documents)
    common = often.join(hosts, "host").filter(F.col("n_documents") > rules.max_line_share * F.col("n_host")).select("host", "h")
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lines.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    removed = met.groupBy("rid").agg(F.sum("w").cast("long").alias("n_common_words"), F.collect_list("h").alias("common_lines"))
    joined = measured.drop("lines", "body", "host").join(removed, "rid", "left")
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    taken = F.coalesce("n_common_words", F.lit(0))
    left = F.col("n_words") - taken
    depleted: Column = (taken > 0) & ((left < rules.min_kept_words) | (left < rules.min_kept_share * F.col("n_words")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), taken.alias("n_common_words"), "common_lines")


def kept_documents(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without those that judged() rejects; the columns are those of docs, and texts keep their common lines.

    Rows are told apart by 128 bits of hash of all that a verdict depends on, so equal rows share theirs.
    """
    key = row_key(id_col, text_col, host_col)
    with temporary(docs.sparkSession):
        verdicts = _judged(docs, rules, key, "binary", text_col, host_col)
        rejected = materialise(verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "rejected", stays=True)
    return docs.select(F.struct("*").alias("doc"), key.alias("key")).join(rejected, "key", "left_anti").select("doc.*")


@F.pandas_udf(T.StringType())
def _without_lines(text: pd.Series, hashes: pd.Series) -> pd.Series:
    def cut(t: str, gone: set[int]) -> str:
        return "\n".join(x for x in t.split("\n") if not (x.strip(" \t\r\x0b\x0c") and _hash(normalised_line(x)) in gone))

    return pd.Series([None if t is None else cut(t, set(h)) for t, h in zip(text, hashes)], dtype=object)


def without_common_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """kept_documents() whose texts have lost the lines that are common to their host, with their line ends.

    n_chars, where there is such a column, is counted anew for them; other texts and columns stay as they are. Only texts
    with common lines go through Python. Null texts have no words and go; repeated rows share a verdict and all stay or go;
    an empty table stays empty.
    """
    key = row_key(id_col, text_col, host_col)
    with temporary(docs.sparkSession):
        verdicts = _judged(docs, rules, key, "binary", text_col, host_col)
        marked = verdicts.filter("NOT kept OR n_common_words > 0").select(F.col("doc_id").alias("key"), "kept", "common_lines").dropDuplicates(["key"])
        marked = materialise(marked, "marked", stays=True)
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key")).join(marked, "key", "left").filter(F.coalesce("kept", F.lit(True)))
    old = F.col(f"doc.{text_col}")
    rows = rows.withColumn("new", _without_lines(F.when(F.col("common_lines").isNotNull(), old), "common_lines"))
    changed = {text_col: F.coalesce("new", old)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
