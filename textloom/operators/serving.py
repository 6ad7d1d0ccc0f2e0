"""Request logs: caches with and without bounds, histories, messages."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen_hits(requests: DataFrame, key: str, *order: str) -> DataFrame:
    """requests with hit: whether the key came before, as in a cache without bounds. The first request of a key is found by a partial aggregate."""
    first = requests.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    return requests.join(first, key).withColumn("hit", F.struct(*order) != F.col("__first")).drop("__first")


class LruCache:
    """Keys with sizes, at most `entries` of them and `size` in all; what was used longest ago goes first.

    An entry larger than the cache still goes in, alone.
    """

    def __init__(self, entries: int, size: int | None = None):
        self.entries, self.size, self.used, self.kept = entries, size, 0, OrderedDict()

    def ask(self, key: str, size: int = 1) -> tuple[bool, int]:
        """(hit, evictions); a key that is missing is put in."""
        if key in self.kept:
            self.kept.move_to_end(key)
            return True, 0
        gone = 0
        while self.kept and (len(self.kept) >= self.entries or self.size is not None and self.used + size > self.size):
            self.used -= self.kept.popitem(last=False)[1]
            gone += 1
        self.kept[key] = size
        self.used += size
        return False, gone


def lru_simulation(requests: DataFrame, cache: str, key: str, order: list[str], entries: int, size: str | None = None, most_size: int | None = None) -> DataFrame:
    """(cache, requests, hits, misses, evictions) of an LRU cache for each value of cache.

    A cache's requests follow each other, so they are one task's work, but as a stream in order: memory holds the
    cache, not the log. Spread a service over more caches to spread the work.
    """
    slim = requests.select(F.col(cache).cast("string").alias("cache"), F.col(key).cast("string").alias("key"), (F.col(size).cast("long") if size else F.lit(1).cast("long")).alias("size"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ordered = slim.repartition("cache").sortWithinPartitions("cache", *[f"o{i}" for i in range(len(order))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, lru, counts = [], None, None, [0, 0, 0]
        for part in parts:
            for c, k, n in zip(*(part.column(i).to_pylist() for i in range(3))):
                if lru is None or c != now:
                    if lru is not None:
                        rows.append((now, *counts))
                    now, lru, counts = c, LruCache(entries, most_size), [0, 0, 0]
                hit, gone = lru.ask(k, n)
                counts = [counts[0] + 1, counts[1] + hit, counts[2] + gone]
        if lru is not None:
            rows.append((now, *counts))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["cache", "requests", "hits", "evictions"])

    out = ordered.select("cache", "key", "size").mapInArrow(run, "cache string, requests long, hits long, evictions long")
    return out.withColumn("misses", F.col("requests") - F.col("hits"))


def history(requests: DataFrame, at: str, key: str, n: int = 50) -> DataFrame:
    """The newest requests."""
    return requests.orderBy(F.desc(at), F.desc(key)).limit(n)


def responses(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with error, for empty texts, and valid ones without."""
    return messages.withColumn("error", F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty text"))


def assembled(tokens: DataFrame, session: str, order: str, token: str, done: str) -> DataFrame:
    """(session, text): tokens joined in order up to the first that is marked as done."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    open_ = tokens.withColumn("__over", F.coalesce(F.max(F.col(done).cast("int")).over(w), F.lit(0))).filter("__over = 0")
    item = F.struct(F.col(order).alias("i"), F.coalesce(token, F.lit("")).alias("t"))
    return open_.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "").alias("text"))
