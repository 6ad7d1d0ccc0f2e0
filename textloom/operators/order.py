"""Deterministic random order, and ranks that don't bring all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise

#: Hexadecimal digits of the hash by which it's cut into ranges, and how many there are.
DIGITS = 3
RANGES = 16**DIGITS


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """A random order that is the same on every run and in other engines: the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def ranked(df: DataFrame, order: Column, tie: str, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with the rank, from 1 on, in a hexadecimal order such as shuffle_key(), and by tie.

    Equal to row_number() over (partition by within order by order, tie), but each range of the hash is ranked in its
    own task and moved by the sum of the counts before it. Those are at most RANGES for a group.
    """
    within = within or []
    rows = df.withColumn("__h", order).withColumn("__r", F.conv(F.substring("__h", 1, DIGITS), 16, 10).cast("int"))
    before = Window.partitionBy(*within).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*within, "__r").count()
    offsets = counts.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__r").alias("__q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    same = F.col("__r") == F.col("__q")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.row_number().over(Window.partitionBy(*within, "__r").orderBy("__h", tie))
    out = rows.withColumn("__n", inside).join(offsets, same).withColumn(name, (F.col("__n") + F.col("__before")).cast("long"))
    return out.select(*df.columns, name)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with the position, from 1 on, in the order of columns, whose values may be spread in any way.

    Equal to row_number() over (order by order), but ranges of the order, as Spark finds them, are numbered apart and moved
    by the counts before them. The ranges are written once, so all that follows sees the same. Rows equal in all columns
    of the order may take each other's place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.struct("*").alias("row"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).repartitionByRange(parts, *[f"o{i}" for i in range(len(order))])
    rows = materialise(ranged.withColumn("at", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("at").count()
    # A row for each range, however large the input.
    before = counts.select("at", F.coalesce(F.sum("count").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("at").orderBy(*[f"o{i}" for i in range(len(order))]))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "at").select("row.*", (F.col("inside") + F.col("before")).cast("long").alias(name))
