"""Reuse distances of a request log: how many other keys are asked for between two uses of a key, which says what any LRU cache hits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import scan
from textloom.operators.order import numbered
from textloom.session import materialise

#: Requests of a range, about, and ranges at most: the table of ranges by ranges has their square.
RANGE, RANGES = 200_000, 4096


def earlier_and_smaller(values: np.ndarray) -> np.ndarray:
    """For each value how many before it are smaller, by merging: bits of the ranks from the highest on, each level at once."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    # Equal values rank by place, so that an earlier equal one would count; those are taken off at the end.
    out, order = np.zeros(n, np.int64), np.arange(n)
    for bit in range(max(1, n - 1).bit_length() - 1, -1, -1):
        group, high = rank[order] >> (bit + 1), (rank[order] >> bit) & 1
        zeros = np.cumsum(1 - high) - (1 - high)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        base = np.repeat(zeros[first], np.diff(first, append=n)) if n else zeros
        out[order] += np.where(high == 1, zeros - base, 0)
        order = order[np.argsort(group * 2 + high, kind="stable")]
    place = np.argsort(values, kind="stable")
    same = np.concatenate([[False], values[place][1:] == values[place][:-1]]) if n else np.zeros(0, bool)
    run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    out[place] -= run
    return out


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, pos, before, asks), in their order within ranges, to (pos, n): rows before in the same range whose `before` is smaller."""
    kept: list[pa.RecordBatch] = []

    def counted(rows: pa.Table) -> pa.RecordBatch:
        pos, before, asks = (rows.column(k).to_numpy() for k in (1, 2, 3))
        n = earlier_and_smaller(before)
        return pa.RecordBatch.from_arrays([pa.array(pos[asks]), pa.array(n[asks])], names=["pos", "n"])

    for part in parts:
        at = 0
        here = part.column(0).to_numpy()
        for cut in [*(np.flatnonzero(np.diff(here)) + 1).tolist(), len(part)]:
            if kept and kept[0].column(0)[0].as_py() != here[at]:
                yield counted(pa.Table.from_batches(kept))
                kept = []
            kept.append(part.slice(at, cut - at))
            at = cut
    if kept and len(kept[0]):
        yield counted(pa.Table.from_batches(kept))


def reuse_distances(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """requests with pos, from 1 on, before (the position of the key's last use) and distance: the different keys asked for in between.

    before and distance are null at a key's first use. With p the position of the use before, distance is the number of
    earlier requests whose own p is smaller, less p. It's counted in ranges: pairs within one range of positions or one range
    of p are counted in its task, all others from the table of how many requests each two ranges share. So one log is many
    tasks, and a key with a third of all requests is no task's alone. order has to tell requests apart; null keys are one key.
    """
    rows = numbered(requests, *order, name="pos")
    rows = materialise(scan.prefixes(rows, [key], ["pos"], before=("max", "pos")), "uses")
    n = rows.count()
    width = max(1, RANGE, math.ceil(n / RANGES))
    # First uses have p = 0 and are dealt out by position: nothing asks about them, and they count for all later ones.
    slim = rows.select("pos", F.coalesce("before", F.lit(0)).alias("p"), F.floor((F.col("pos") - 1) / width).cast("int").alias("a"))
    slim = slim.withColumn("b", F.when(F.col("p") > 0, F.floor((F.col("p") - 1) / width).cast("int")).otherwise(-1)).withColumn("asks", F.col("p") > 0)
    schema = "pos long, n long"
    within = slim.select("a", "pos", "p", "asks").repartition("a").sortWithinPartitions("a", "pos").mapInArrow(_count, schema)
    # Within a range of p, by p: rows of earlier ranges of positions come before where p is smaller. Counted on ranges in place of positions.
    by_p = slim.filter("asks").select("b", "pos", "a", "asks", "p").repartition("b").sortWithinPartitions("b", "p").select("b", "pos", "a", "asks")
    across = by_p.mapInArrow(_count, schema)
    cells = slim.groupBy("a", "b").agg(F.count("*").alias("n"))
    ranges = rows.sparkSession.range(0, max(1, math.ceil(n / width)))
    grid = ranges.select(F.col("id").cast("int").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(max(0, math.ceil(n / width) - 1)))))
    earlier = lambda by, at: Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    corner = filled.withColumn("up", F.sum("n").over(earlier("b", "a"))).withColumn("grid", F.coalesce(F.sum("up").over(earlier("a", "b")), F.lit(0))).select("a", "b", "grid")
    counted = within.union(across).groupBy("pos").agg(F.sum("n").alias("near"))
    asked = slim.filter("asks").join(corner, ["a", "b"]).join(counted, "pos").select(F.col("pos").alias("__pos"), (F.col("near") + F.col("grid") - F.col("p")).alias("distance"))
    return rows.join(asked, F.col("pos") == F.col("__pos"), "left").drop("__pos")


def lru_curve(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """(entries, requests, hits, misses, evictions) of an LRU cache for each number of entries, from reuse distances.

    A request hits just when fewer other keys than entries came in between. Each miss puts an entry in, and from the time the
    cache is full one goes for it. All sizes are answered from one histogram.
    """
    counts = distances.groupBy("distance").agg(F.count("*").alias("n"))
    sizes = distances.sparkSession.createDataFrame([(int(c),) for c in capacities], "entries long")
    hit = F.when(F.col("distance") < F.col("entries"), F.col("n")).otherwise(0)
    met = counts.withColumn("entries", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in capacities])))
    found = met.groupBy("entries").agg(F.sum("n").alias("requests"), F.sum(F.coalesce(hit, F.lit(0))).alias("hits"))
    out = sizes.join(found, "entries", "left").na.fill(0).withColumn("misses", F.col("requests") - F.col("hits"))
    return out.withColumn("evictions", F.greatest(F.col("misses") - F.col("entries"), F.lit(0)))
