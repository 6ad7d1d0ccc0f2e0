"""Prefixes over long series: blocks of the order are summed up apart, their summaries combined, and the rest applied to rows.

A series may hold all rows. It is cut at ranges of its order, as Spark finds them, so each task has a block; what a block
hands on to the next is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise

#: Kinds of prefixes: how rows of a block, and then blocks, are combined.
KINDS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def in_blocks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with __block, written once: ranges of by and order, ascending. Rows equal in all of these are in one block."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*by, *order]]
    return materialise(df.repartitionByRange(parts, *keys).withColumn("__block", F.spark_partition_id()), "blocks")


def _carried(rows: DataFrame, by: list[str], carry: DataFrame, names: list[str]) -> DataFrame:
    """rows with what their series brings into their block; carry has a row for each block that isn't its series' first."""
    right = carry.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__block").alias("__same_block"), *names)
    same = F.col("__block") == F.col("__same_block")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(right, same, "left").drop("__same_block", *[f"__of_{c}" for c in by])


def prefixes(df: DataFrame, by: list[str], order: list[str], inclusive: bool = False, **measures: tuple[str, str]) -> DataFrame:
    """df with a column for each measure (kind, column): its sum, count, min or max over the rows before, also this one if inclusive.

    The same as a window over `by`, ordered by `order`, from its beginning on, also where one series holds all rows. by
    may be empty. order has to tell rows of a series apart, else equal rows may be in either order. A sum or count of no rows is 0,
    a minimum or maximum of none is null; so are those of values that are all null.
    """
    rows = in_blocks(df, by, order)
    within = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)) if kind in ("sum", "count") else c
    value = {n: F.col(c).isNotNull().cast("long") if kind == "count" else F.col(c) for n, (kind, c) in measures.items()}
    local = {n: KINDS[kind](value[n]).over(within).alias(f"__in_{n}") for n, (kind, _) in measures.items()}
    whole = rows.groupBy(*by, "__block").agg(*[KINDS[kind](value[n]).alias(f"__own_{n}") for n, (kind, _) in measures.items()])
    carry = whole.select(*by, "__block", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy("__block")).alias("__k"), *[KINDS[kind](f"__own_{n}").over(earlier).alias(f"__to_{n}") for n, (kind, _) in measures.items()])
    out = _carried(rows.select("*", *local.values()), by, carry.filter("__k > 1"), [f"__to_{n}" for n in measures])

    def both(name: str, kind: str) -> Column:
        a, b = F.col(f"__in_{name}"), F.col(f"__to_{name}")
        if kind in ("sum", "count"):
            return zero(a, kind) + zero(b, kind)
        return (F.least if kind == "min" else F.greatest)(a, b)  # nulls are passed over

    return out.select(*df.columns, *[both(n, kind).alias(n) for n, (kind, _) in measures.items()])


def _from_first(keep: float):
    """Rows (..., series, value), sorted by series and order, with what a series that begins at its first value in this block has come to, and after how many rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state, n = None, 0.0, 0
        for part in parts:
            series = part.column(part.num_columns - 2).to_pylist()
            values, states, counts = part.column(part.num_columns - 1).to_pylist(), [], []
            for s, v in zip(series, values):
                if s != before:
                    before, state, n = s, v or 0.0, 0
                state = state * keep + (v or 0.0) * (1 - keep)
                n += 1
                states.append(state)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(states, pa.float64()), pa.array(counts, pa.int64())], names=[*part.schema.names[:-2], "__state", "__n"])

    return run


def _chain(keep: float):
    """Blocks of a series (__block, __end, __rows, __first) with how much more than its first value each begins from: affine maps one after the other."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("__block", ignore_index=True)
        state, starts = float(blocks["__first"].iloc[0]), np.zeros(len(blocks))
        for i, (end, rows, first) in enumerate(zip(blocks["__end"], blocks["__rows"], blocks["__first"])):
            starts[i] = state
            state = end + keep**rows * (state - first)
        return blocks[["__series", "__block"]].assign(__more=starts - blocks["__first"])

    return run


def exponential(df: DataFrame, by: str, order: str, value: str, keep: float, name: str = "smoothed") -> DataFrame:
    """(by, order, name): s = keep * s before + (1 - keep) * value, from the first value of the series on.

    A block of n rows is an affine map of the state that it begins from: what it comes to from its own first value, and
    keep ** n times what the state differs from that. So blocks are done apart and only these two numbers of each are put together, for any keep from 0 to 1. A null
    value counts as zero. Rows of a series are told apart by their order.
    """
    if not 0 <= keep <= 1:
        raise ValueError("keep must be from 0 to 1")
    slim = df.select(F.col(by).alias(by), F.col(order).alias(order), F.col(value).cast("double").alias("__v"))
    rows = in_blocks(slim, [by], [order])
    series = F.coalesce(F.col(by).cast("string"), F.lit("null"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # A block is one partition of a table that was written by ranges, and is dealt out by its number.
    ordered = rows.repartition("__block").sortWithinPartitions("__block", by, order)
    ready = ordered.select(by, order, "__block", "__v", F.concat(F.col("__block").cast("string"), F.lit(":"), series).alias("__s"), F.col("__v").alias("__w"))
    schema = f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, __block int, __v double, __state double, __n long"
    done = materialise(ready.mapInArrow(_from_first(keep), schema), "states")
    ends = done.groupBy(F.col(by).alias("__key"), "__block").agg(F.max_by("__state", "__n").alias("__end"), F.max("__n").alias("__rows"), F.min_by("__v", order).alias("__first"))
    ends = ends.select(F.coalesce(F.col("__key").cast("string"), F.lit("null")).alias("__series"), "__block", "__end", "__rows", F.coalesce("__first", F.lit(0.0)).alias("__first"))
    ends = ends.withColumn("__blocks", F.count("*").over(Window.partitionBy("__series")))
    # Most series are within one block; the others have as many rows here as blocks.
    chained = ends.filter("__blocks > 1").groupBy("__series").applyInPandas(_chain(keep), "__series string, __block int, __more double")
    starts = ends.filter("__blocks = 1").select("__series", "__block", F.lit(0.0).alias("__more")).union(chained)
    out = done.withColumn("__series", series).join(starts, ["__series", "__block"])
    return out.select(by, order, (F.col("__state") + F.col("__more") * F.pow(F.lit(keep), F.col("__n"))).alias(name))
